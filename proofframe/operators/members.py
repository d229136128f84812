"""Comparison of two folders member by member, each by the rules of its kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.delimited import cells
from ..sources.json_text import json_differences
from ..storage import stored
from .compare import bytes_diff
from .tables import row_differences

SHOWN = 256


def profile(name: Column) -> Column:
    """How members of a name are compared: table, json, text or bytes."""
    lower = F.lower(name)
    return F.when(lower.rlike(r"\.(csv|tsv)$"), "table").when(lower.endswith(".json"), "json").when(lower.rlike(r"\.(txt|log|md|html)$"), "text").otherwise("bytes")


def first_line(a: Column, b: Column) -> Column:
    """The first line that differs: location, expected and found; null where none does."""
    lines = F.arrays_zip(F.split(a, "\n").alias("x"), F.split(b, "\n").alias("y"))
    spot = F.array_position(F.transform(lines, lambda z: z["x"].eqNullSafe(z["y"])), False)
    at = F.get(lines, (spot - 1).cast("int"))
    return F.when(spot > 0, F.struct(F.concat(F.lit("line "), spot.cast("string")).alias("location"), F.left(at["x"], F.lit(SHOWN)).alias("expected"), F.left(at["y"], F.lit(SHOWN)).alias("found")))


def first_cell(a: Column, b: Column, sep: Column) -> Column:
    """The first row that differs by width, type or value of a cell; the first row is a header."""

    def rows(text: Column) -> Column:
        lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
        return F.transform(lines, lambda line: F.when(sep == "\t", cells(line, "\t")).otherwise(cells(line, ",")))

    both = F.arrays_zip(rows(a).alias("x"), rows(b).alias("y"))

    def row(z: Column, i: Column) -> Column:
        lone = F.struct(F.lit("availability").alias("w"), F.when(z["x"].isNotNull(), "row").alias("e"), F.when(z["y"].isNotNull(), "row").alias("f"))
        d = F.get(row_differences(z["x"], z["y"], i == 0), F.lit(0))
        what = F.when(z["x"].isNull() & z["y"].isNull(), None).when(z["x"].isNull() | z["y"].isNull(), lone).when(d.isNotNull(), F.struct(d["what"].alias("w"), d["expected"].alias("e"), d["found"].alias("f")))
        where = F.concat(F.lit("row "), (i + 1).cast("string"), F.coalesce(F.concat(F.lit(" column "), d["column"].cast("string")), F.lit("")))
        return F.when(what.isNotNull(), F.struct(F.concat(where, F.lit(" "), what["w"]).alias("location"), what["e"].alias("expected"), what["f"].alias("found")))

    return F.get(F.array_compact(F.transform(both, row)), F.lit(0))


def first_byte(a: Column, b: Column) -> Column:
    d = bytes_diff(a, b)
    size = F.struct(F.lit("size").alias("location"), d["a_bytes"].cast("string").alias("expected"), d["b_bytes"].cast("string").alias("found"))
    hexed = lambda x: F.lower(F.hex(F.substr(x.cast("binary"), (d["first"] + 1).cast("int"), F.lit(1))))
    byte = F.struct(F.concat(F.lit("byte "), d["first"].cast("string")).alias("location"), hexed(a).alias("expected"), hexed(b).alias("found"))
    return F.when(~d["equal"], F.when(d["first"].isNull(), size).otherwise(byte))


def member_differences(expected: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """keys, name, profile, location, expected and found of the first difference of every member (keys, name, content)
    that differs. Members that one side lacks have location members; a member's name chooses its rules, see `profile`."""
    on = [*keys, "name"]
    both = expected.select(*on, F.struct("content").alias("a")).join(found.select(*on, F.struct("content").alias("b")), on, "full_outer")
    a, b = F.col("a.content"), F.col("b.content")
    both = stored(both.where(F.col("a").isNull() | F.col("b").isNull() | ~a.eqNullSafe(b)).withColumn("profile", profile(F.col("name"))), "members")
    pairs = both.where("a is not null and b is not null")
    there = lambda c: F.when(F.col(c).isNotNull(), "member")
    lone = both.where("a is null or b is null").select(*on, "profile", F.lit("members").alias("location"), there("a").alias("expected"), there("b").alias("found"))

    def inside(kind: str, first: Column) -> DataFrame:
        return pairs.where(F.col("profile") == kind).select(*on, "profile", first.alias("d")).where("d is not null").select(*on, "profile", "d.*")

    texts = pairs.where("profile = 'json'").select(*on, "profile", a.alias("x"), b.alias("y"))
    listed = json_differences(texts, "x", "y", *on, "profile")
    jsons = listed.groupBy(*on, "profile").agg(F.min(F.struct("path", "expected", "found")).alias("d")).select(*on, "profile", F.col("d.path").alias("location"), "d.expected", "d.found")
    sep = F.when(F.lower("name").endswith(".tsv"), "\t").otherwise(",")
    for part in (inside("text", first_line(a, b)), inside("table", first_cell(a, b, sep)), inside("bytes", first_byte(a, b)), jsons):
        lone = lone.unionByName(part)
    return lone
