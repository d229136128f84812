"""Centroid clustering in exact integers, with a tournament of bisectors for the nearest centroid.

Vectors become integers, floor(scale * x). For two centroids i < j the points nearer to j are those x with
x . 2(cj - ci) > |cj|^2 - |ci|^2; zero or less keeps i, the smaller number. Normals and thresholds of all pairs are worked
out once a round. A vector then meets the centroids in order of their numbers: of the one kept so far and the next, one
linear sign test drops one, so k - 1 tests leave the nearest, ties to the smaller number; its distance alone is computed,
exactly. A round's vectors are added up by centroid inside each task, so what is shuffled is k x dimensions numbers a task,
however many vectors share one centroid or are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Integer components stay below this, so that sign tests and squared distances of a few hundred dimensions fit a long.
LIMIT = 1 << 26
ROWS = 4096  # vectors tested at a time: normals are picked for each of them


class Bisectors:
    """Normals 2(cj - ci) and thresholds |cj|^2 - |ci|^2 of all pairs i < j of centroids (k x dimensions, integers)."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = c = np.ascontiguousarray(centroids, np.int64)
        square = (c * c).sum(1)
        self.normals = 2 * (c[None, :, :] - c[:, None, :])
        self.thresholds = square[None, :] - square[:, None]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid, and the squared distance to it."""
        best = np.zeros(len(x), np.int64)
        for j in range(1, len(self.centroids)):
            side = np.einsum("nd,nd->n", x, self.normals[best, j])
            best[side > self.thresholds[best, j]] = j  # zero leaves the smaller number
        away = x - self.centroids[best]
        return best, np.einsum("nd,nd->n", away, away)


def integers(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id and v: the components as 32-bit integers, in bytes, of the vectors that take part, as a stored table.

    Vectors that are null, of another length than dim, or holding a null, a NaN, an infinity or a component that
    scaling takes beyond LIMIT (its distances would not fit a long) take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(batch), dim)
            whole = np.floor(scale * values).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in whole], pa.binary())], names=["vec_id", "v"])

    x = F.col("embedding")
    fits = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(F.floor(e.cast("double") * scale).cast("double")) <= LIMIT))
    kept = vectors.where(x.isNotNull() & (F.size(x) == dim)).where(fits)
    return written(kept.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, v binary"), "integers")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of equally long binaries of 32-bit integers as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), dim).astype(np.int64)


def starts(rows: DataFrame, k: int, seed: int, dim: int) -> np.ndarray:
    """The k vectors whose ids have the smallest sha256 of `seed:id`, in that order (fewer, if there are fewer); equal
    ids in order of their components' bytes. Null ids start nothing."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").orderBy(key, "v").limit(k).select("v").toArrow().column(0)
    return matrix(first, dim)


def sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """For each centroid that is nearest to some vector, how many these are and the sums of their components: k numbers
    of rows and k x dimensions sums in all come to the driver."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors, total, n = Bisectors(centroids), np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                x = matrix(batch.column(0)[a : a + ROWS], dim)
                best, _ = bisectors.nearest(x)
                order = np.argsort(best, kind="stable")
                numbers, first = np.unique(best[order], return_index=True)
                total[numbers] += np.add.reduceat(x[order], first)
                n += np.bincount(best, minlength=k)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen]), pa.array(list(total[seen]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = rows.select("v").mapInArrow(run, "cluster long, n long, total array<long>")
    exact = "decimal(38,0)"
    cells = parts.select("cluster", "n", F.posexplode("total").alias("place", "x")).groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast(exact)).alias("x"))
    out: dict[int, tuple[int, list[int]]] = {}
    for cluster, _, n, x in sorted(tuple(r) for r in cells.collect()):
        out.setdefault(cluster, (n, []))[1].append(int(x))
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance (squared, in integers), cluster_inertia and inertia (distance summed over the cluster and
    over all) and centroid_sha256 (of the final centroid's components in decimal, joined by commas) of every vector that
    takes part (see `integers`), from vectors (vec_id, embedding).

    Centroids start as `starts` says; each round replaces every centroid that is nearest to some vector by the floor of
    its vectors' mean, component by component; the last assignment follows. Equal vectors and repeated or null ids are
    rows of their own; with fewer vectors than k there are fewer centroids; a table without vectors gives no rows. Other
    columns are not read.
    """
    rows = integers(vectors, dim, scale)
    centroids = starts(rows, k, seed, dim)
    if not len(centroids):
        return rows.where(F.lit(False)).select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        for number, (n, total) in sums(rows, centroids).items():
            centroids[number] = [x // n for x in total]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors = Bisectors(centroids)
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                best, away = bisectors.nearest(matrix(batch.column(1)[a : a + ROWS], dim))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + ROWS], pa.array(best, pa.int32()), pa.array(away)], names=["vec_id", "cluster", "distance"])

    found = written(rows.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    facts = [(i, int(d), hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, d in sorted(inertia.items())]
    named = F.create_map(*(x for i, d, h in facts for x in (F.lit(i), F.struct(F.lit(d).cast("long").alias("d"), F.lit(h).alias("h")))))
    own = named[F.col("cluster")]
    return found.select("vec_id", "cluster", "distance", own["d"].alias("cluster_inertia"), F.lit(sum(d for _, d, _ in facts)).cast("long").alias("inertia"), own["h"].alias("centroid_sha256"))
