"""Comparison of datasets with explicit rules for keys, tolerance, NaN and signed zero."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_double(a: Column, b: Column) -> Column:
    """Equal doubles: NaN equals NaN, 0.0 is not -0.0, null equals null."""
    zero = (a.cast("string") == "-0.0") == (b.cast("string") == "-0.0")
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((a == b) & zero)


def same(a: Column, b: Column, kind: str) -> Column:
    return same_double(a, b) if kind in ("double", "float") else a.eqNullSafe(b)


def within(a: Column, b: Column, tolerance: str) -> Column:
    """Whether numbers differ by at most tolerance: in decimals of the printed values, to 18 places, where these have room
    (below 1e20), else as doubles. NaN is within no tolerance of anything."""
    x, y = a.try_cast("decimal(38,18)"), b.try_cast("decimal(38,18)")
    number = ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double"))
    return number & F.coalesce(F.abs(x - y) <= F.lit(Decimal(tolerance)), F.abs(a.cast("double") - b.cast("double")) <= float(tolerance))


def bytes_diff(a: Column, b: Column, block: int = 512) -> Column:
    """Whether two texts or binaries are equal, their sizes in bytes, and the offset of the first byte that differs: null
    where sizes differ, which is told first, or where all are equal. Null is equal to null alone.

    The first block that differs is found by slices, then the byte in it."""
    a, b = (x.cast("binary") for x in (a, b))
    part = lambda x, at, n: F.substr(x, at + 1, F.lit(n))
    starts = F.sequence(F.lit(0), F.octet_length(a), F.lit(block))
    at = F.filter(starts, lambda i: part(a, i, block) != part(b, i, block))[0]
    byte = F.filter(F.sequence(at, at + block - 1), lambda i: part(a, i, 1) != part(b, i, 1))[0]
    equal = a.eqNullSafe(b)
    first = F.when(~equal & (F.octet_length(a) == F.octet_length(b)), byte)
    return F.struct(equal.alias("equal"), *(F.octet_length(x).cast("long").alias(n) for x, n in ((a, "a_bytes"), (b, "b_bytes"))), first.cast("long").alias("first"))


def full(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left and right, full outer by keys, as struct columns a and b (null where missing)."""
    a = left.select(*keys, F.struct(*left.columns).alias("a"))
    b = right.select(*keys, F.struct(*right.columns).alias("b"))
    return a.join(b, keys, "full_outer")


def delta(left: DataFrame, right: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """keys and change: added, deleted, changed or same."""
    kinds = dict(left.dtypes)
    equal = F.lit(True)
    for c in compare:
        equal = equal & same(F.col(f"a.{c}"), F.col(f"b.{c}"), kinds[c])
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(equal, "same").otherwise("changed")
    return full(left, right, keys).select(*keys, change.alias("change"))


def cell_diff(left: DataFrame, right: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """keys, field, expected, found (as text) of cells that differ, and of rows that one side lacks (field null)."""
    kinds = dict(left.dtypes)
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    cells = F.array(*(F.when(both & ~same(F.col(f"a.{c}"), F.col(f"b.{c}"), kinds[c]), F.struct(F.lit(c).alias("field"), F.col(f"a.{c}").cast("string").alias("expected"), F.col(f"b.{c}").cast("string").alias("found"))) for c in compare))
    lone = F.when(~both, F.struct(F.lit(None).cast("string").alias("field"), F.when(F.col("a").isNotNull(), "row").alias("expected"), F.when(F.col("b").isNotNull(), "row").alias("found")))
    rows = full(left, right, keys).select(*keys, F.explode(F.array_compact(F.concat(cells, F.array(lone)))).alias("d"))
    return rows.select(*keys, "d.field", "d.expected", "d.found")


def tolerance_outcome(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: str) -> DataFrame:
    """keys and outcome: exact, within, changed, missing (found nowhere) or extra; both sides' structs stay as a, b."""
    kind = dict(left.dtypes)[value]
    a, b = F.col(f"a.{value}"), F.col(f"b.{value}")
    outcome = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(same(a, b, kind), "exact").when(within(a, b, tolerance), "within").otherwise("changed")
    return full(left, right, keys).withColumn("outcome", outcome)


def array_diff(left: Column, right: Column) -> Column:
    """Struct of shape_equal and first: the first place (from 0) where arrays of doubles differ, -1 without one."""
    places = F.transform(F.arrays_zip(left.alias("x"), right.alias("y")), lambda z, i: F.when(~same_double(z["x"], z["y"]), i))
    return F.struct((F.size(left) == F.size(right)).alias("shape_equal"), F.coalesce(F.array_min(F.array_compact(places)), F.lit(-1)).alias("first"))


def perturbed(orders: DataFrame) -> DataFrame:
    """A copy of orders with some prices off and some rows missing, by fixed rules on the key."""
    k = F.col("o_orderkey")
    price = F.when(k % 97 == 0, F.round(F.col("o_totalprice") + 0.02, 2)).when(k % 89 == 0, F.round(F.col("o_totalprice") + 0.005, 3)).otherwise(F.col("o_totalprice"))
    return orders.where(k % 101 != 0).withColumn("o_totalprice", price)
