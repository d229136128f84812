"""Which record stands for a material: its own, else that of the one directory that covers it; and which producer owns a
directory at the time it is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixpoint import ancestors
from .order import running


def above(path: Column) -> Column:
    """The proper ancestors of a path."""
    every = ancestors(path)
    return F.slice(every, 1, F.size(every) - 1)


def resolved(materials: DataFrame, records: DataFrame, directories: DataFrame, key: str, path: str = "path") -> DataFrame:
    """materials with how (exact, directory, ambiguous or none) and record, a struct of the columns of records or null.

    records and directories have the same columns, path among them, and one row for a path. A material without a record of
    its own takes that of the directory that covers it; where several do, that is kept as ambiguous. key tells materials
    apart. Ancestors are joined by equality, so a directory with many materials is no product."""
    columns = F.struct(*(c for c in records.columns))
    exact = records.select(F.col("path").alias(path), columns.alias("own"))
    with_own = materials.join(exact, path, "left")
    lone = with_own.where("own is null").select(key, F.explode(above(F.col(path))).alias("ancestor"))
    covering = directories.select(F.col("path").alias("ancestor"), columns.alias("covering"))
    found = lone.join(covering, "ancestor").groupBy(key).agg(F.count("*").alias("n"), F.min("covering").alias("covering"))
    how = F.when(F.col("own").isNotNull(), "exact").when(F.col("n") == 1, "directory").when(F.col("n") > 1, "ambiguous").otherwise("none")
    record = F.coalesce("own", F.when(F.col("n") == 1, F.col("covering")))
    return with_own.join(found, key, "left").select(*materials.columns, how.alias("how"), record.alias("record"))


def currentness(found: DataFrame, fields: list[str]) -> DataFrame:
    """found (of `resolved`) with state and mismatches: unrecorded, ambiguous, unconfirmed, mismatch or current; which
    fields differ between a material and its record, in the order given. A directory's record is compared with the columns
    covering_<field> where there are some."""
    def present(f: str) -> Column:
        return F.when(F.col("how") == "directory", F.col(f"covering_{f}")).otherwise(F.col(f)) if f"covering_{f}" in found.columns else F.col(f)

    unlike = F.array_compact(F.array(*(F.when(~present(f).eqNullSafe(F.col(f"record.{f}")), f) for f in fields)))
    state = F.when(F.col("how") == "ambiguous", "ambiguous").when(F.col("how") == "none", "unrecorded").when(~F.col("record.confirmed"), "unconfirmed")
    return found.withColumn("state", state.when(F.size(unlike) > 0, "mismatch").otherwise("current")).withColumn("mismatches", F.when(F.col("state") == "mismatch", unlike))


def directory_inputs(consumers: DataFrame, outputs: DataFrame, made: DataFrame) -> DataFrame:
    """consumers (consumer, seq, directory, member) with owners, conflicts, the owner where there is one alone, missing and
    verdict (valid, no_owner, several_owners, conflict or missing_member).

    outputs (producer, seq, path) are files, made (producer, seq, path) directories. At a consumer's seq count what was
    made before it: an owner made the directory or one above it; a conflict is another producer with a file or a directory
    inside it. A producer begins to count once and turns from conflict to owner once, so both numbers are running sums of
    these turns by directory, and no consumer is paired with a producer."""
    targets = consumers.select("directory").distinct()
    up = targets.select("directory", F.explode(ancestors(F.col("directory"))).alias("path"))
    owned = made.join(up, "path").groupBy("directory", "producer").agg(F.min("seq").alias("own"))
    parts = outputs.unionByName(made).select("producer", "seq", F.explode(above(F.col("path"))).alias("directory"))
    inside = parts.join(targets, "directory", "left_semi").groupBy("directory", "producer").agg(F.min("seq").alias("within"))
    turns = owned.join(inside, ["directory", "producer"], "full_outer")
    step = lambda seq, owner, conflict: F.struct(seq.alias("seq"), F.lit(owner).alias("owner"), F.lit(conflict).alias("conflict"))
    clash = F.col("within").isNotNull() & (F.col("own").isNull() | (F.col("within") < F.col("own")))
    steps = F.array_compact(F.array(F.when(F.col("own").isNotNull(), step(F.col("own"), 1, 0)), F.when(clash, step(F.col("within"), 0, 1)), F.when(clash & F.col("own").isNotNull(), step(F.col("own"), 0, -1))))
    rows = turns.select("directory", F.explode(steps).alias("s")).select("directory", "s.seq", F.lit(None).cast("long").alias("consumer"), F.lit(None).cast("string").alias("member"), "s.owner", "s.conflict")
    asked = consumers.select("directory", "seq", F.col("consumer").cast("long").alias("consumer"), "member", F.lit(0).alias("owner"), F.lit(0).alias("conflict"))
    order = [F.col("seq"), F.col("consumer").isNull(), F.col("consumer")]  # at one seq who asks comes first
    both = F.col("owner").cast("long") * (1 << 32) + F.col("conflict")  # two sums in one
    swept = running(rows.unionByName(asked), ["directory"], order, both, "sums").where("consumer is not null")
    counted = swept.select("consumer", "directory", "member", F.shiftright("sums", 32).alias("owners"), F.col("sums").bitwiseAND(F.lit((1 << 32) - 1)).alias("conflicts"))
    first = owned.groupBy("directory").agg(F.min_by("producer", F.struct("own", "producer")).alias("owner"))
    single = counted.join(first, "directory", "left").withColumn("owner", F.when(F.col("owners") == 1, F.col("owner")))
    there = outputs.select(F.col("producer").alias("owner"), F.col("path").alias("member"), F.lit(True).alias("there")).distinct()
    out = single.join(there, ["owner", "member"], "left").withColumn("missing", F.col("owner").isNotNull() & F.col("there").isNull())
    verdict = F.when(F.col("owners") == 0, "no_owner").when(F.col("owners") > 1, "several_owners").when(F.col("conflicts") > 0, "conflict").when(F.col("missing"), "missing_member").otherwise("valid")
    return out.select("consumer", "directory", "member", "owners", "conflicts", "owner", "missing", verdict.alias("verdict"))
