"""Sinks that can be run again: slots, idempotent appends, latest pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def publish_slots(rows: DataFrame, path: str, slot: str = "slot") -> None:
    """Writes rows, replacing the slots that they have and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(slot).parquet(path)


def append_plan(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys of new and outcome: appended, kept (the same digest is there) or conflict (another digest is there)."""
    there = stored.select(*keys, F.col("digest").alias("known"))
    outcome = F.when(F.col("known").isNull(), "appended").when(F.col("known") == F.col("digest"), "kept").otherwise("conflict")
    return new.join(there, keys, "left").select(*keys, outcome.alias("outcome"))


def upsert_latest(pointers: DataFrame, new: DataFrame, invalid: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Pointers without the invalid ones, with new ones; of one key's the greatest stays."""
    kept = pointers.join(invalid, order, "left_anti").select(*keys, order).unionByName(new.select(*keys, order))
    return kept.groupBy(*keys).agg(F.max(order).alias(order))
