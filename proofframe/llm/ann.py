"""Approximate nearest neighbours by stable projections, kd-trees and a chi-square stopping test.

Vectors are projected on M random Gaussian directions. Of two vectors at distance d the projections are apart by d
times a chi variable with M degrees of freedom, so nearness in the projection is evidence of nearness. A search walks
single neighbours by growing projected distance and verifies each in double precision; it stops where a vector as near
as the k-th found would, with a chance of CONFIDENCE, have shown up already: where the next projected distance,
squared, is REACH (that quantile of chi-square) times the k-th distance, squared.

Rows. A coarse kd-tree, fitted on a bounded sample of projected rows, deals every row into one cell, and large cells are
dealt into blocks of about BLOCK rows, whatever they hold (copies of one vector too). A row is in one block and never
copied; a task holds one block's rows with their own kd-tree, and the queries stream past.

Queries. Each first searches one block of the cell nearest to it. The k-th distance found there bounds it: a second
round goes only to blocks whose cell's box passes the stopping test with that bound, and starts from it there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

M = 32
CONFIDENCE = 0.92
K = 10
LEAF = 64
BLOCK = 8_192  # rows that a task holds at a time
CELLS, CELL_SAMPLE = 1_024, 64  # most cells, and sampled rows for each: at most 65 536 projected rows reach the driver
STEPS = (32, 256)  # neighbours verified between two tests: at first, and at most
ROUNDING = 1e-9  # projected distances within this are equal
PLACED = "cell int, sub int, kind int, vec_id long, embedding array<{}>, bound double"


def projection(dim: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, M))


def chance_within(x: float) -> float:
    """The chi-square distribution with M (even) degrees of freedom: the chance to be at most x."""
    half = x / 2
    term = total = 1.0
    for i in range(1, M // 2):
        term *= half / i
        total += term
    return 1 - np.exp(-half) * total


def quantile(chance: float) -> float:
    low, high = 0.0, 1e3
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chance_within(middle) < chance else (low, middle)
    return high


REACH = quantile(CONFIDENCE)


def limit_of(distance: float | np.ndarray) -> float | np.ndarray:
    """The projected distance, squared, at which a search with this k-th distance stops."""
    return REACH * distance * distance + ROUNDING


def off_box(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least projected distance, squared, from a point to each box."""
    off = np.maximum(np.maximum(low - q, q - high), 0)
    return (off * off).sum(1)


class KDTree:
    """A kd-tree's leaves over projected points: numbers of the points and the leaves' bounding boxes."""

    def __init__(self, points: np.ndarray):
        self.points, self.leaves = points, []
        todo = [np.arange(len(points))]
        while todo:
            own = todo.pop()
            spread = np.ptp(points[own], axis=0) if len(own) else np.zeros(1)
            if len(own) <= LEAF or spread.max() == 0:
                self.leaves.append(own)
                continue
            axis = int(spread.argmax())
            order = own[np.argsort(points[own, axis], kind="stable")]
            todo += [order[len(order) // 2 :], order[: len(order) // 2]]
        self.low = np.array([points[x].min(0) for x in self.leaves])
        self.high = np.array([points[x].max(0) for x in self.leaves])


class Cells:
    """A coarse kd-tree of 2^depth cells: each inner node splits the sample's widest axis at its median."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.value = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        parts = [points]
        for node in range(len(self.axis)):
            own = parts[node]
            if len(own):
                self.axis[node] = np.ptp(own, axis=0).argmax()
                self.value[node] = np.median(own[:, self.axis[node]])
            right = own[:, self.axis[node]] > self.value[node]
            parts += [own[~right], own[right]]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.value[node])
        return node - len(self.axis)


def nearest(
    ids: np.ndarray, vectors: np.ndarray, tree: KDTree, q_id: int, q: np.ndarray, q_low: np.ndarray, k: int, bound: float = np.inf, seen: list[int] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest found of one block, no farther than bound and without the query itself: ids and distances, ties to
    the smaller id, each id once. seen: gets the number of rows verified."""
    far = off_box(tree.low, tree.high, q_low)
    leaves = np.argsort(far, kind="stable")
    best_id, best, kth = np.zeros(0, np.int64), np.zeros(0), bound
    wait, apart = np.zeros(0, np.int64), np.zeros(0)  # points of opened leaves by projected distance, not yet verified
    at, opened, step, verified = 0, 4, STEPS[0], 0
    while True:
        ahead = far[leaves[at]] if at < len(leaves) else np.inf
        if min(ahead, apart[0] if len(apart) else np.inf) >= limit_of(kth):
            break
        ready = np.searchsorted(apart, ahead, "right")  # nothing in a leaf to come is nearer
        if not ready:
            if at == len(leaves):
                break
            new = np.concatenate([tree.leaves[i] for i in leaves[at : at + opened]])
            at, opened = at + opened, min(2 * opened, 32)
            wait, apart = np.concatenate([wait, new]), np.concatenate([apart, ((tree.points[new] - q_low) ** 2).sum(1)])
            order = np.flatnonzero(apart < limit_of(kth))
            order = order[np.argsort(apart[order], kind="stable")]
            wait, apart = wait[order], apart[order]
            continue
        some = wait[: min(ready, step)]
        wait, apart, step = wait[len(some) :], apart[len(some) :], min(2 * step, STEPS[1])
        verified += len(some)
        d = np.sqrt(((vectors[some] - q) ** 2).sum(1))
        own = (ids[some] != q_id) & (d <= kth)
        if own.any():
            best_id, best = np.concatenate([best_id, ids[some][own]]), np.concatenate([best, d[own]])
            order = np.lexsort((best_id, best))
            best_id, best = best_id[order], best[order]
            first = np.sort(np.unique(best_id, return_index=True)[1])[:k]
            best_id, best = best_id[first], best[first]
            kth = min(bound, best[-1]) if len(best) == k else bound
    if seen is not None:
        seen.append(verified)
    return best_id, best


def flat(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class Index:
    """Cells over the projections of rows, with the box and the number of blocks of each, all of bounded size."""

    def __init__(self, rows: DataFrame, dim: int, n: int):
        self.rows, self.dim, self.kind = rows, dim, rows.schema["embedding"].dataType.elementType.simpleString()
        depth = max(0, int(np.ceil(np.log2(max(1, min(CELLS, n / BLOCK))))))
        size = CELL_SAMPLE * 2**depth
        directions = projection(dim)
        sample = []
        if depth:
            some = rows.where(F.rand(5) < min(1.0, 1.2 * size / n)).select("embedding").limit(size).toArrow()
            sample = flat(some.column("embedding").combine_chunks(), dim) @ directions
        self.cells = cells = Cells(np.asarray(sample).reshape(-1, M), depth)

        def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = np.zeros(2**depth, np.int64)
            low, high = np.full((2**depth, M), np.inf), np.full((2**depth, M), -np.inf)
            for batch in batches:
                points = flat(batch.column(0), dim) @ directions
                own = cells.of(points)
                np.add.at(count, own, 1)
                np.minimum.at(low, own, points)
                np.maximum.at(high, own, points)
            full = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(count[full]), pa.array(list(low[full]), pa.list_(pa.float64())), pa.array(list(high[full]), pa.list_(pa.float64()))], names=["cell", "n", "low", "high"])

        parts = rows.select("embedding").mapInArrow(boxes, "cell long, n long, low array<double>, high array<double>")
        ends = [F.array(*(f(F.col(c)[i]) for i in range(M))).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))]
        found = sorted(parts.groupBy("cell").agg(F.sum("n").alias("n"), *ends).collect())
        self.full = np.array([r["cell"] for r in found], np.int64)
        self.low, self.high = (np.array([r[c] for r in found]).reshape(-1, M) for c in ("low", "high"))
        self.blocks = np.ones(2**depth, np.int64)
        self.blocks[self.full] = [-(-r["n"] // BLOCK) for r in found]

    def placed(self) -> DataFrame:
        """Every row in its block, dealt by its place in its task."""
        dim, cells, blocks, directions = self.dim, self.cells, self.blocks, projection(self.dim)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = 0
            for batch in batches:
                cell = cells.of(flat(batch.column(1), dim) @ directions)
                sub = (at + np.arange(len(cell))) % blocks[cell]
                at += len(cell)
                n = len(cell)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(sub, pa.int32()), pa.array(np.zeros(n), pa.int32()), batch.column(0), batch.column(1), pa.nulls(n, pa.float64())], names=["cell", "sub", "kind", "vec_id", "embedding", "bound"])

        return self.rows.select("vec_id", "embedding").mapInArrow(run, PLACED.format(self.kind))

    def routed(self, queries: DataFrame) -> DataFrame:
        """The blocks that each query (vec_id, embedding, bound) asks: with a bound all that may hold a row within it,
        else one block of the nearest cell."""
        dim, directions, full, low, high, blocks = self.dim, projection(self.dim), self.full, self.low, self.high, self.blocks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points, bounds = flat(batch.column(1), dim) @ directions, batch.column(2).to_numpy(zero_copy_only=False)
                for i, (point, bound) in enumerate(zip(points, bounds, strict=True)):
                    far = off_box(low, high, point)
                    if np.isnan(bound):
                        cell = full[[far.argmin()]]
                        sub = np.array([batch.column(0)[i].as_py()]) % blocks[cell]
                    else:
                        some = full[far < limit_of(bound)]
                        cell = np.repeat(some, blocks[some])
                        sub = np.concatenate([np.arange(blocks[c]) for c in some]) if len(some) else some
                    one = batch.slice(i, 1).take(pa.array(np.zeros(len(cell)), pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(sub, pa.int32()), pa.array(np.ones(len(cell)), pa.int32()), *one.columns], names=["cell", "sub", "kind", "vec_id", "embedding", "bound"])

        return queries.select("vec_id", "embedding", "bound").mapInArrow(run, PLACED.format(self.kind))

    def asked(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, vec_id, score: the k nearest found of each block that a query asks."""
        dim, directions = self.dim, projection(self.dim)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows by (cell, sub, kind): a block's rows are held, then its queries pass."""
            key, held, block = None, [], None
            for batch in batches:
                names = [np.asarray(c) for c in batch.columns[:3]]
                ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in names], axis=0)) + 1 if batch.num_rows else []
                for p, q in zip([0, *ends], [*ends, batch.num_rows], strict=True):
                    if p == q:
                        continue
                    if (names[0][p], names[1][p]) != key:
                        key, held, block = (names[0][p], names[1][p]), [], None
                    own = batch.slice(p, q - p)
                    ids, vectors = np.array(own.column(3)), flat(own.column(4), dim)
                    if names[2][p] == 0:
                        held.append((ids, vectors))
                    elif held or block:
                        if block is None:
                            block = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                            block, held = (*block, KDTree(block[1] @ directions)), []
                        bounds = own.column(5).to_numpy(zero_copy_only=False)
                        found = [nearest(*block, *x, k, np.inf if np.isnan(b) else b) for *x, b in zip(ids, vectors, vectors @ directions, bounds, strict=True)]
                        sizes = [len(x) for x, _ in found]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), *(pa.array(np.concatenate(x)) for x in zip(*found, strict=True))], names=["query_id", "vec_id", "score"])

        both = self.placed().unionByName(self.routed(queries))
        n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return both.repartition(n, "cell", "sub").sortWithinPartitions("cell", "sub", "kind").mapInArrow(run, "query_id long, vec_id long, score double")


def search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of each query's k nearest found, nearest first.

    rows and queries have vec_id and embedding. Vectors that are null, zero, of another length than most, or hold null
    or non-finite components take no part, nor do rows without a vec_id; a query is never its own neighbour (by
    vec_id); fewer candidates give fewer rows, empty tables none; a repeated vec_id is found once, at its least
    distance, and as a query it stands for the first vector in order; ties go to the smaller vec_id; other columns
    aren't read.
    """

    def clean(df: DataFrame) -> DataFrame:
        v = F.col("embedding")
        kind = "array<float>" if df.schema["embedding"].dataType.simpleString() == "array<float>" and rows.schema["embedding"].dataType == df.schema["embedding"].dataType else "array<double>"
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast(kind).alias("embedding")).where(F.col("vec_id").isNotNull() & fine)

    asked, rows = clean(queries), clean(rows)
    sizes = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = (df.where(F.size("embedding") == sizes["dim"]) for df in (rows, asked))
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select("vec_id", F.col("embedding").cast(rows.schema["embedding"].dataType).alias("embedding"))
    index = Index(rows, sizes["dim"], sizes["n"])
    found = written(index.asked(asked.withColumn("bound", F.lit(None).cast("double")), k), "neighbours")
    if index.blocks.sum() > 1:
        kth = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.max("score")).otherwise(F.lit(float("inf"))).alias("bound"))
        bounded = asked.join(kth, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        found = found.unionByName(index.asked(bounded, k)).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
