"""Results that are kept from run to run: a keyed table with one complete generation for each run.

A generation is written whole under its number and counts from the moment its number is in the list of commits, which is
one appended file. A run that dies before leaves the old generation as it was, and the next run writes over what is left.
One run writes at a time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..storage import exists, removed, stored

#: Keys of up to so many misses are sent to the rows instead of the rows to them.
BROADCAST_ROWS = 200_000


class Generations:
    """A table of schema in the folder path, by generation; `keep` of them stay, the committed one among them."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 2):
        self.spark, self.path, self.schema, self.keep = spark, path, schema, keep

    def latest(self) -> int:
        """The number of the last committed generation, 0 before the first."""
        if not exists(self.spark, f"{self.path}/commits"):
            return 0
        return self.spark.read.schema("generation long").parquet(f"{self.path}/commits").agg(F.max("generation")).first()[0] or 0

    def read(self, generation: int | None = None) -> DataFrame:
        """The rows of a generation (the last committed one); none before the first."""
        number = self.latest() if generation is None else generation
        if not number:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/generation={number}")

    def write(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/generation={number}")

    def commit(self, rows: DataFrame) -> DataFrame:
        """rows as the next generation; gives them as they are stored."""
        number = self.latest() + 1
        self.write(rows, number)
        self.spark.range(1).select(F.lit(number).cast("long").alias("generation")).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        if number > self.keep:
            removed(self.spark, f"{self.path}/generation={number - self.keep}")
        return self.read(number)


def same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[c])
    return out


def refreshed(cache: Generations, rows: DataFrame, keys: Sequence[str], identity: Sequence[str], compute: Callable[[DataFrame], DataFrame], values: Sequence[str]) -> tuple[DataFrame, int]:
    """(keys, identity, values and reused of every key in rows; how many rows were computed).

    A key whose identity is what the last generation has (null equals null) takes its values from there; the others alone
    go through compute, which gives keys, identity and values. All become the next generation, so keys that rows no longer
    have are evicted. rows may carry large columns that only compute needs: hits are found without them. Keys must be
    unique in rows and not null; an empty table makes an empty generation."""
    narrow = rows.select(*keys, *identity)
    old = cache.read()
    hit = narrow.join(old, same(narrow, old, [*keys, *identity]))
    found = hit.select(*(narrow[c] for c in [*keys, *identity]), *(old[v] for v in values))
    counter = Observation()
    if cache.latest():
        missed = stored(narrow.join(found.select(*keys), list(keys), "left_anti").select(*keys), "missed")
        missed = F.broadcast(missed) if missed.count() <= BROADCAST_ROWS else missed
        todo = rows.join(missed, list(keys), "left_semi")
    else:
        todo = rows
    made = compute(todo).select(*keys, *identity, *values).observe(counter, F.count("*").alias("n"))
    all_rows = found.withColumn("reused", F.lit(True)).unionByName(made.withColumn("reused", F.lit(False)))
    return cache.commit(all_rows), counter.get["n"]
