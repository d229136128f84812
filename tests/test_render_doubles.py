"""The JVM's number format against exact decimals, on many doubles."""

import random
import struct
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import functions as F

from proofframe.functions import render


def values():
    r = random.Random(6)
    out = [0.0, -0.0, 2.675, 1.005, 0.125, -0.125, 0.5, 1.5, 2.5, -2.5, 9.996, 99.95, 0.00095, 1e-300, 5e-324, 2.0**53, 2.0**53 - 1, 2.0**60, 1e22, 1.7e308, -(2.0**53), 0.1, 0.3, 123456789.5, 999999.5, 1e15, 4503599627370497.5]
    out += [r.randrange(10**7) / 2**k for k in range(30) for _ in range(20)]  # ties in binary
    out += [r.uniform(-1000, 1000) for _ in range(1500)] + [round(r.uniform(0, 500_000), 2) / 2 for _ in range(1500)]
    for _ in range(1500):
        x = struct.unpack("<d", r.randbytes(8))[0]
        if x == x and abs(x) < 1e300:
            out.append(x)
    return out


def plain_fixed(x, places):
    text = format(Decimal(x).quantize(Decimal(1).scaleb(-places), ROUND_HALF_EVEN, render.WIDE), "f")
    return text if text.strip("-0.") else text.lstrip("-")


def plain_scientific(x, digits):
    c, e = format(Decimal(x) if x else Decimal(0), f".{digits - 1}e").split("e")
    return f"{c}e{int(e) if x else 0}"


def plain_significant(x, digits):
    if not x:
        return format(Decimal(0), f".{digits - 1}f")
    rounded = Decimal(format(Decimal(x), f".{digits - 1}e"))
    return format(rounded, f".{max(digits - 1 - rounded.adjusted(), 0)}f")


def test_doubles_are_rounded_by_their_exact_values(spark):
    xs = values()
    df = spark.createDataFrame([(x,) for x in xs], "x double").repartition(4)
    v = F.col("x")
    got = df.select("x", *(render.fixed(v, p).alias(f"f{p}") for p in (0, 2, 7)), *(render.scientific(v, d).alias(f"e{d}") for d in (1, 3, 15)), *(render.significant(v, d).alias(f"s{d}") for d in (1, 3, 9)), render.half_even(v, 2).cast("string").alias("h")).collect()
    for r in got:
        x = r["x"]
        assert [r[f"f{p}"] for p in (0, 2, 7)] == [plain_fixed(x, p) for p in (0, 2, 7)], x
        assert [r[f"e{d}"] for d in (1, 3, 15)] == [plain_scientific(x, d) for d in (1, 3, 15)], x
        assert [r[f"s{d}"] for d in (1, 3, 9)] == [plain_significant(x, d) for d in (1, 3, 9)], x
        assert r["h"] is None or Decimal(r["h"]) == Decimal(plain_fixed(x, 2))


def test_what_is_no_number(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "x double")
    assert {tuple(r) for r in df.select(render.fixed(F.col("x"), 2), render.significant(F.col("x"), 3), render.scientific(F.col("x"), 3)).collect()} == {(None, None, None)}


def test_ties_of_whole_numbers_go_to_the_even_figure(spark):
    xs = [198500.0, 65450.0, 9725.0, 9715.0, 1005.0, 1015.0, -1005.0, 25.0, 2500.0, 1.985e20, 0.125, 12.25, 1.5, 2.5, 0.0625]
    xs += [float(k * 10**e + 5 * 10 ** (e - 1)) for k in range(100, 120) for e in (1, 2, 6, 12)] + [(2 * k + 1) / 2**n for k in range(60) for n in range(1, 12)]
    v = F.col("x")
    out = [(f"e{d}", render.scientific, plain_scientific, d) for d in (1, 2, 3, 4)] + [(f"s{d}", render.significant, plain_significant, d) for d in (1, 2, 3, 4)] + [(f"f{d}", render.fixed, plain_fixed, d) for d in (0, 1, 2, 3)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *(f(v, d).alias(n) for n, f, _, d in out)).collect()
    assert [(r["x"], n, r[n]) for r in got for n, _, plain, d in out if r[n] != plain(r["x"], d)] == []
