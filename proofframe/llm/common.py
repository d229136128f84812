"""Helpers shared by the corpus operators: tables, shared folders, word-cached encoding, Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder, stored  # noqa: F401

ARROW_LIMIT, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    return stored(df, label, **options)


def small_batches(spark: SparkSession) -> None:
    """Texts are long: a session that holds more bytes in an Arrow batch than ARROW_BYTES is set to that. It bounds what
    the executor and its Python workers hold at a time, and changes no result."""
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(ARROW_LIMIT))
    if not now or int(now[1]) > ARROW_BYTES:
        spark.conf.set(ARROW_LIMIT, str(ARROW_BYTES))


def docs_text(docs: DataFrame) -> DataFrame:
    """doc_id and text, null texts as empty ones."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def rows_and_text(docs: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.Array]]:
    """docs as one struct column `row` of the columns in keep, whatever their names, and what gives a batch's texts,
    null ones as empty. Texts travel once: only where keep lacks text, they are a second column."""
    small_batches(docs.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")
    if "text" not in keep:
        return docs.select(row, F.coalesce("text", F.lit("")).alias("text")), lambda batch: batch.column(1)
    at = list(keep).index("text")
    return docs.select(row), lambda batch: batch.column(0).flatten()[at].fill_null("")


def slices(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """[start, end) runs whose sizes sum to about limit; an item above it stands alone."""
    start = total = 0
    i = -1
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if i >= start:
        yield start, i + 1


class WordCache:
    """Encodings of texts as concatenations of their words' encodings, each word encoded once while the bounded cache
    has it; when the cache is full, only the words of the texts at hand stay, and words above LONG characters stay for
    their batch alone, so that few of them can't fill the memory. encode(words) gives bytes for each."""

    LONG = 64

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 300_000):
        self.encode, self.limit, self.cache = encode, limit, {}

    def blobs(self, lists: list[list[str]]) -> list[bytes]:
        words = set().union(*lists)
        new = list(words.difference(self.cache))
        if len(self.cache) + len(new) > self.limit:
            self.cache = {w: self.cache[w] for w in words.difference(new)}
        self.cache.update(zip(new, self.encode(new), strict=True))
        get = self.cache.__getitem__
        out = [b"".join(map(get, x)) for x in lists]
        for w in new:
            if len(w) > self.LONG:
                del self.cache[w]
        return out


def cut_long(text: str, limit: int = 1_000_000) -> list[str]:
    """text in pieces of about limit characters, cut before a space so that words stay whole."""
    if len(text) <= limit:
        return [text]
    out, at = [], 0
    while len(text) - at > limit:
        if (to := text.find(" ", at + limit)) < 0:
            break
        out.append(text[at:to])
        at = to
    return [*out, text[at:]]
