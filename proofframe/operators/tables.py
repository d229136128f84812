"""Positional comparison of two delimited tables by typed cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.render import cell_type

DIFFERENCE = "column int, what string, expected string, found string"


def same_cell(a: Column, b: Column, kind: Column) -> Column:
    """Whether two cells of one kind have one value: integers of any size, floats with NaN equal to NaN and 0.0 unlike
    -0.0, booleans in any case, text as it is."""
    digits = lambda c: F.when(c.rlike("^[+-]?0$"), "0").otherwise(F.ltrim(c, F.lit("+")))
    number = lambda c: F.regexp_replace(F.lower(c), "inf$", "infinity").try_cast("double")
    zero = lambda c: (number(c) == 0) & c.startswith("-")
    return (
        F.when(kind == "integer", digits(a) == digits(b))
        .when(kind == "float", number(a).eqNullSafe(number(b)) & (F.coalesce(zero(a), F.lit(False)) == F.coalesce(zero(b), F.lit(False))))
        .when(kind == "boolean", F.lower(a) == F.lower(b))
        .otherwise(a.eqNullSafe(b))
    )


def row_differences(a: Column, b: Column, header: Column) -> Column:
    """Differences of two rows of cells, as an array of structs: one of width where they have unlike numbers of cells,
    else one for each cell of another type or value; cells of a header are text."""

    def cell(z: Column, i: Column) -> Column:
        x, y = F.coalesce(z["x"], F.lit("")), F.coalesce(z["y"], F.lit(""))
        kind_x, kind_y = (F.when(header, "text").otherwise(cell_type(c)) for c in (x, y))
        what = F.when(kind_x != kind_y, "type").when(~same_cell(x, y, kind_x), "value")
        return F.when(what.isNotNull(), F.struct((i + 1).alias("column"), what.alias("what"), x.alias("expected"), y.alias("found")))

    text = lambda c: F.size(c).cast("string")
    width = F.array(F.struct(F.lit(None).cast("int").alias("column"), F.lit("width").alias("what"), text(a).alias("expected"), text(b).alias("found")))
    return F.when(F.size(a) != F.size(b), width).otherwise(F.array_compact(F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), cell)))


def table_differences(expected: DataFrame, found: DataFrame, header: bool = False) -> DataFrame:
    """position, column (from 1; null for a whole row), what, expected and found of what differs between two tables of
    positioned rows (position, row, line, cells).

    what: availability (a position that one side lacks), malformed (a line whose quotes are out of place, compared as
    text), width, type or value. With header, the first row of each file is text."""
    a, b = (df.select("position", F.struct("line", "cells", (F.lit(header) & (F.col("row") == 1)).alias("header")).alias(n)) for df, n in ((expected, "a"), (found, "b")))
    both = a.join(b, "position", "full_outer")
    one = lambda what, x, y: F.array(F.struct(F.lit(None).cast("int").alias("column"), F.lit(what).alias("what"), x.alias("expected"), y.alias("found")))
    there = lambda c: F.when(F.col(c).isNotNull(), "row")
    bad = F.col("a.cells").isNull() | F.col("b.cells").isNull()
    differences = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), one("availability", there("a"), there("b")))
        .when(bad & (F.col("a.line") == F.col("b.line")), F.array().cast(f"array<struct<{DIFFERENCE.replace(' ', ':').replace(',:', ',')}>>"))
        .when(bad, one("malformed", F.col("a.line"), F.col("b.line")))
        .otherwise(row_differences(F.col("a.cells"), F.col("b.cells"), F.col("a.header")))
    )
    return both.select("position", F.explode(differences).alias("d")).select("position", "d.column", "d.what", "d.expected", "d.found")
