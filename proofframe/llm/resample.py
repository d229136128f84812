"""Importance resampling towards a target distribution.

Features are hashed runs of words. A bucket's gain, from how often it occurs in the raw and in the target texts, is one
number of an array; a document's weight is the mean of its features' gains, looked up in it. Noise by a document's id turns
the weights into keys, of which the largest are drawn without replacement. The k-th largest composite key (score, then
smaller doc_id) is found by quickselect over the scored table: random pivots, exact counts above and at each of them, then
the interval that holds the k-th goes on; only the winners are sorted and ranked, by ranges.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import ranked
from .common import small_batches, written

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8: no ASCII but digits and letters
PIECE = 1 << 18  # bytes whose words are held at a time
PIVOTS = 15


def pieces(text: bytes) -> Iterator[bytes]:
    """text in runs of about PIECE bytes that end between words."""
    a = 0
    while len(text) - a > PIECE:
        b = a + PIECE
        while (gap := WORD.match(text, b)) and WORD.match(text, b - 1):
            b = gap.end()
        yield text[a:b]
        a = b
    yield text[a:]


class Buckets:
    """Bucket numbers of a text's features: all runs of 1 to `width` words, joined by a space, repeats counted."""

    def __init__(self, width: int, buckets: int):
        self.width, self.buckets = width, buckets

    def runs(self, text: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """How many words a piece of the text has, and the buckets of the runs that end in it."""
        carried: list[int | None] = [None] * (self.width - 1)  # CRCs of the runs of 1, 2, .. words that the last piece ended with
        for piece in pieces(text.lower()):
            words = WORD.findall(piece)
            if not words:
                continue
            level: list[int | None] = [crc32(w) for w in words]
            out, ends = list(level), [level[-1]]
            spaced = [b" " + w for w in words]
            for c in carried:  # a run of n + 1 words goes on from the run of n that ends one word before
                level = [None if p is None else crc32(w, p) for w, p in zip(spaced, [c, *level[:-1]], strict=True)]
                out += [x for x in level if x is not None]
                ends.append(level[-1])
            carried = ends[:-1]
            yield len(words), np.array(out, np.int64) % self.buckets


def bucket_counts(texts: DataFrame, width: int, buckets: int) -> np.ndarray:
    """How many features of all texts (text) fall into each bucket. A task sends one array; these are added up by Spark,
    and `buckets` numbers come to the driver."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, make = np.zeros(buckets, np.int64), Buckets(width, buckets)
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()).to_pylist():
                for _, found in make.runs(text):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = texts.where("text is not null").select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of B buckets, in doubles."""
    b, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    ratio = [(float(t + 1) * float(s_all + b)) / (float(s + 1) * float(t_all + b)) for s, t in zip(raw.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, width: int) -> DataFrame:
    """doc_id, n_features, n_words and weight of every document: the floored mean of its features' gains, 0 without any."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Buckets(width, len(gain))
        for batch in batches:
            features, words, weight = [], [], []
            for text in batch.column(1).cast(pa.large_binary()).to_pylist():
                n = w = total = 0
                for count, found in make.runs(text):
                    n, w, total = n + len(found), w + count, total + int(gain[found].sum())
                features.append(n)
                words.append(w)
                weight.append(total // n if n else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(features, pa.int64()), pa.array(words, pa.int64()), pa.array(weight, pa.int64())], names=["doc_id", "n_features", "n_words", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")


def noise(seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h being the first 8 hex digits of sha256(`seed:doc_id`)."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def above(score: int, doc_id: int) -> Column:
    """Whether a row's key comes before (score, doc_id): a higher score, or the same and a smaller id."""
    return (F.col("score") > score) | ((F.col("score") == score) & (F.col("doc_id") < doc_id))


def kth_key(rows: DataFrame, k: int, seed: int = 7) -> tuple[int, int] | None:
    """The k-th key (score, doc_id) of rows in order of falling score and growing doc_id, repeats counted; None without
    k rows.

    Quickselect: of the rows still in question, those with the smallest hash of key and round are the pivots; one job
    counts the rows before and at every pivot exactly, and the interval that holds the k-th goes on. PIVOTS keys a round
    come to the driver."""
    rows = rows.select("score", "doc_id")
    done, inside = 0, F.lit(True)  # rows before the interval, and what says that a row is in it
    turn = 0
    while True:
        turn += 1
        left = rows.where(inside)
        picked = left.orderBy(F.xxhash64("score", "doc_id", F.lit(seed), F.lit(turn)), "score", "doc_id").limit(PIVOTS).collect()
        pivots = sorted({(r["score"], r["doc_id"]) for r in picked}, key=lambda p: (-p[0], p[1]))
        if not pivots:
            return None
        equal = lambda p: (F.col("score") == p[0]) & (F.col("doc_id") == p[1])
        counts = left.agg(*(f for p in pivots for f in (F.count_if(above(*p)), F.count_if(equal(p))))).first()
        low = high = None
        for i, p in enumerate(pivots):
            before, at = done + counts[2 * i], counts[2 * i + 1]
            if before < k <= before + at:
                return p
            if k <= before:
                high = p
                break
            low, passed = p, before + at
        if low is not None:
            done = passed
            inside = inside & ~above(*low) & ~equal(low)
        if high is not None:
            inside = inside & above(*high)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, width: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document of docs (doc_id, text): rank is 1, 2, .. over the
    floor(percent * N / 100) drawn of the N documents with at least least_words words, null for the others.

    Null texts have no features, weight 0 and are never drawn, as documents of few words; all texts are read whole and
    counted in the raw distribution, those of target (text) in the other. A null doc_id has no score, counts not in N and
    isn't drawn. Repeated rows are rows of their own; of equal keys at the limit as many are drawn as there is room for.
    An empty target gives gains by the raw counts alone; an empty docs no rows. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, width, buckets), bucket_counts(target, width, buckets))
    score = (F.col("weight") + noise(seed)).cast("long").alias("score")
    scored = written(weights(docs, gain, width).select("doc_id", "n_features", "n_words", "weight", score), "scored")
    able = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    k = scored.where(able).count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long")
    key = kth_key(scored.where(able), k, seed) if k else None
    if key is None:
        return scored.select(*out, none.alias("rank"))
    won = F.coalesce(able & ~(F.col("score") < key[0]) & ~((F.col("score") == key[0]) & (F.col("doc_id") > key[1])), F.lit(False))
    winners = ranked(scored.where(won).select(out), [F.desc("score"), F.col("doc_id"), F.col("weight"), F.col("n_features")])
    winners = winners.select(*out, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return winners.unionByName(scored.where(~won).select(*out, none.alias("rank")))
