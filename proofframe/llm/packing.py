"""Packing of token sequences by non-negative least squares.

A document's ids are cut into runs of `window` and a rest; run and rest are pieces. Piece lengths, rounded up to
multiples of `grain`, form a histogram of window/grain bins. All combinations of up to three bins that fill a window
exactly are enumerated; non-negative least squares finds how often to use each so that the histogram is used up; the
counts are rounded down; what is left is packed greedily, largest bins first, on the histogram. All of that works on
counts, so it costs the same for any number of documents. Pieces then take their places by their rank in their bin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import docs_text, slices, written
from .token_ids import token_ids

WINDOW = 4096
GRAIN = 16
SALTS_ROWS = 50_000  # pieces for each part of a bin that is ranked by one task, about
CELLS = 4096  # parts of all ranks that seats are cut at
BATCH_BYTES = 2_000_000


def combinations(bins: int) -> list[tuple[int, ...]]:
    """Multisets of one to three bin numbers that sum to bins, largest first."""
    out: list[tuple[int, ...]] = [(bins,)]
    out += [(a, bins - a) for a in range(bins - 1, (bins - 1) // 2, -1)]
    out += [(a, b, bins - a - b) for a in range(bins - 2, 0, -1) for b in range(min(a, bins - a - 1), 0, -1) if b >= bins - a - b >= 1]
    return out


def nonnegative_least_squares(a: np.ndarray, y: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |a x - y|, by the active-set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    free: list[int] = []
    slope = a.T @ y
    limit = 1e-9 * max(1.0, float(np.abs(slope).max(initial=0)))
    for _ in range(rounds):
        slope[free] = -np.inf
        if not len(slope) or slope.max() <= limit:
            break
        free.append(int(slope.argmax()))
        while True:
            sub = a[:, free]
            z = np.linalg.solve(sub.T @ sub + 1e-10 * np.eye(len(free)), sub.T @ y)
            if z.min() > 0:
                break
            now = x[free]
            down = z <= 0
            step = (now[down] / np.maximum(now[down] - z[down], 1e-300)).min()
            now = np.maximum(now + step * (z - now), 0)
            now[down & (now <= 1e-12)] = 0
            if not (now == 0).any():
                now[np.argmin(now)] = 0
            x[:] = 0
            x[[f for f, v in zip(free, now, strict=True) if v > 0]] = now[now > 0]
            free = [f for f, v in zip(free, now, strict=True) if v > 0]
            if not free:
                break
        if free:
            x[:] = 0
            x[free] = z
        slope = a.T @ (y - a[:, free] @ x[free]) if free else a.T @ y
    return x


def plan(histogram: dict[int, int], bins: int) -> list[tuple[tuple[int, ...], int]]:
    """(bins of a sequence, how many such sequences), using every counted piece exactly once."""
    left = np.zeros(bins + 1, np.int64)
    for b, n in histogram.items():
        left[b] = n
    combos = combinations(bins)
    a = np.zeros((bins + 1, len(combos)))
    for k, c in enumerate(combos):
        for b in c:
            a[b, k] += 1
    scale = max(1, left.max())
    times = np.floor(nonnegative_least_squares(a, left / scale) * scale + 1e-6).astype(np.int64)
    out: list[tuple[tuple[int, ...], int]] = []

    def use(c: tuple[int, ...], most: int | None) -> None:
        need = np.bincount(c, minlength=bins + 1)
        n = int((left[need > 0] // need[need > 0]).min())
        n = n if most is None else min(n, most)
        if n > 0:
            left[:] -= n * need
            out.append((c, n))

    for k in np.argsort(-times, kind="stable"):
        if times[k] > 0:
            use(combos[k], int(times[k]))
    while left.any():
        had, space, c = left.copy(), bins, []
        while len(some := np.nonzero(had[: space + 1])[0]):
            c.append(int(some[-1]))
            had[c[-1]] -= 1
            space -= c[-1]
        use(tuple(c), None)
    return out


def seats(plans: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(bin, first rank, end rank, sequence of the first rank, slot): where pieces of a bin sit, by rank in the bin."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for c, n in plans:
        for slot, b in enumerate(c):
            r = used.get(b, 0)
            out.append((b, r, r + n, sequence, slot))
            used[b] = r + n
        sequence += n
    return out


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of the pieces of every whole text; ids end with end_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = token_ids(tokenizer_path)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(pc.binary_length(texts).to_pylist(), BATCH_BYTES):
                found = enc.encode(texts.slice(a, b - a))
                rows: list[tuple] = []
                for key, x, n in zip(keys[a:b], found.start.tolist(), found.size.tolist(), strict=True):
                    ids = np.append(found.ids[x : x + n], found.ids.dtype.type(end_id)).astype("<u4")
                    rows += [(key, s, min(window, n + 1 - s), zlib.crc32(ids[s : s + window].tobytes()), n + 1) for s in range(0, n + 1, window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs_text(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(found: DataFrame, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """The pieces with sequence_id (from 0, without gaps) and offset in it.

    found has doc_id, start and length from 1 to window; it is read several times and should be stored. Repeated rows
    are pieces of their own. An empty table gives no rows. What the driver gathers is the histogram of window/grain
    bins; the seats, at most some thousand rows, cut at every
    CELLS-th part of all ranks so that a piece meets those of its own ranks alone, are broadcast. A bin is ranked in salted parts, so pieces of one
    length that are a third of all do not meet in one task.
    """
    bins = window // grain
    piece = F.struct(*(F.col(c) for c in found.columns)).alias("piece")  # whatever its columns are called
    binned = found.select(piece, F.ceil(F.col("length") / grain).cast("int").alias("bin"))
    histogram = {r["bin"]: r["n"] for r in binned.groupBy("bin").agg(F.count("*").alias("n")).collect()}  # <= window/grain rows
    salts = max(16, sum(histogram.values()) // SALTS_ROWS)
    binned = binned.withColumn("salt", F.pmod(F.xxhash64("piece.doc_id", "piece.start"), F.lit(salts)))
    counts = binned.groupBy("bin", "salt").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("bin").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("bin", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("bin", "salt").orderBy("piece.doc_id", "piece.start")) - 1
    ranked = binned.withColumn("own", own).join(counts, ["bin", "salt"]).select("piece", "bin", (F.col("own") + F.col("before")).alias("rank"))
    cell = max(1, -(-sum(histogram.values()) // CELLS))
    places = [(b, c, r, e, s, slot) for b, r, e, s, slot in seats(plan(histogram, bins)) for c in range(r // cell, -(-e // cell))] or [(0, 0, 0, 0, 0, 0)]
    places = F.broadcast(found.sparkSession.createDataFrame(places, "bin int, cell long, first long, end long, sequence long, slot int"))
    seated = ranked.withColumn("cell", F.floor(F.col("rank") / cell)).join(places, ["bin", "cell"])
    seated = seated.where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    seated = seated.select("piece", "slot", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # <= window rows
    offset = F.coalesce(F.sum("piece.length").over(before), F.lit(0))
    return seated.select("piece", "sequence_id", offset.alias("offset")).select("piece.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """pieces of all documents, packed. Null texts are empty: their one id is end_id."""
    return pack(written(pieces(docs, tokenizer_path, end_id, window), "pieces"), window, grain)
