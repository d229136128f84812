"""Global ranks and running sums over tables of any size, without a task that reads a whole group or the whole table.

Rows are dealt out by ranges of their keys and sorted inside each part; a part's number and a row's place in it are written
beside the row. What a row lacks then is only what the parts before it hold: at most one number for each part."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored

PLACE_BITS = 33  # monotonically_increasing_id: a partition's number above, the row's place in it below


def fresh(name: str, taken: Iterable[str]) -> str:
    """name, with as many underscores behind it as make it new, whatever the case of letters."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def placed(df: DataFrame, keys: Sequence[Column]) -> tuple[DataFrame, str, str]:
    """df in order of keys as a stored table, and the names of two columns more: part (ascending with the keys) and place.

    Rows of equal keys come to one part: give keys that tell rows apart."""
    part, place = (fresh(c, df.columns) for c in ("part", "place"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    at = fresh("at", [*df.columns, part, place])
    rows = rows.withColumn(at, F.monotonically_increasing_id())
    low = F.col(f"`{at}`").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return stored(rows.withColumns({part: F.shiftright(f"`{at}`", PLACE_BITS), place: low}).drop(at), "placed"), part, place


def ranked(df: DataFrame, keys: Sequence[Column], name: str = "rank") -> DataFrame:
    """df with each row's rank from 1 in order of keys, as the column name (long); equal keys take turns.

    The sizes of the parts, one row for each, are summed up by one task."""
    rows, part, place = placed(df, keys)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    n, base = fresh("n", rows.columns), fresh("base", rows.columns)
    sizes = rows.groupBy(part).agg(F.count("*").alias(n)).select(part, F.coalesce(F.sum(f"`{n}`").over(before), F.lit(0)).alias(base))
    rank = F.col(f"`{base}`") + F.col(f"`{place}`") + 1
    return rows.join(F.broadcast(sizes), part).select(*(F.col(f"`{c}`") for c in df.columns), rank.alias(name))


def running(df: DataFrame, groups: Sequence[str], keys: Sequence[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows of its group (null is a group) up to itself, in order of keys, as the column
    name. Null values count as 0.

    A group that spans parts needs the sums of the parts before; each part begins inside one group at most, so these are
    fewer rows than there are parts, whatever the groups."""
    own_value = fresh("value", df.columns)
    rows, part, place = placed(df.withColumn(own_value, F.coalesce(value, F.lit(0))), [*(F.col(f"`{g}`") for g in groups), *keys])
    quoted = [f"`{g}`" for g in groups]
    inside = Window.partitionBy(part, *quoted).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*quoted).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    total, carry = (fresh(c, rows.columns) for c in ("total", "carry"))
    sums = rows.groupBy(part, *quoted).agg(F.sum(f"`{own_value}`").alias(total))
    carried = sums.select(part, *quoted, F.sum(f"`{total}`").over(before).alias(carry)).where(F.col(f"`{carry}`").isNotNull())
    right = carried.select(F.col(part).alias("right_part"), *(F.col(q).alias(f"right_{i}") for i, q in enumerate(quoted)), F.col(f"`{carry}`").alias("right_carry"))
    left = rows.select("*", F.sum(f"`{own_value}`").over(inside).alias(total))
    same = left[part] == F.col("right_part")
    for i, q in enumerate(quoted):
        same = same & left[q].eqNullSafe(F.col(f"right_{i}"))
    both = left.join(F.broadcast(right), same, "left")
    return both.select(*(left[f"`{c}`"] for c in df.columns), (F.col(f"`{total}`") + F.coalesce("right_carry", F.lit(0))).alias(name))
