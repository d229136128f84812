"""Small literal tables: keys, tolerance, NaN and signed zero, rendering, graphs, slots."""

import pytest
from pyspark.sql import functions as F

from proofframe.functions import render
from proofframe.operators import compare
from proofframe.operators.components import components
from proofframe.operators.fixpoint import ancestors, levels, reach
from proofframe.sources import files, sinks
from proofframe.storage import shared_path


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_doubles_with_nan_and_signed_zero(spark):
    df = spark.sql("select * from values (double('nan'), double('nan')), (0.0d, -0.0d), (null, null), (1d, null), (1d, 1d) t(a, b)")
    got = [r[0] for r in df.select(compare.same_double(F.col("a"), F.col("b"))).collect()]
    assert got == [True, False, True, False, True]


def test_tolerance(spark):
    a = spark.createDataFrame([(1, 10.0), (2, 7.0), (3, 1.0), (4, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, 10.05), (2, 7.0), (3, 1.2)], "k int, v double")
    got = compare.tolerance_outcome(a, b, ["k"], "v", "0.1").select("k", "outcome")
    assert rows(got) == [(1, "within"), (2, "exact"), (3, "changed"), (4, "missing")]


def test_tolerance_of_tiny_huge_and_missing_numbers(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 1.00000000000001), (1e25, 1.0000000000001e25), (1e25, 2e25), (nan, nan), (nan, 1.0), (float("inf"), 1.0), (0.1, 0.3)], "a double, b double")
    assert [r[0] for r in df.select(compare.within(F.col("a"), F.col("b"), "0.000000000001")).collect()] == [True, False, False, False, False, False, False]
    assert [r[0] for r in df.select(compare.within(F.col("a"), F.col("b"), "0.2")).collect()] == [True, False, False, False, False, False, True]


def test_array_diff_keeps_the_sign_of_zero(spark):
    nan = float("nan")
    df = spark.createDataFrame([([nan, 0.0, 3.0], [nan, -0.0, 3.0]), ([nan, 0.0], [nan, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(compare.array_diff(F.col("a"), F.col("b"))["first"]).collect()] == [1, -1]


def test_bytes_diff_tells_sizes_first_and_bytes_not_characters(spark):
    long = "é" * 700
    data = [("aéb", "aéc"), ("ab", "abc"), ("x", "x"), (None, ""), (None, None), (long + "p", long + "q"), ("z" * 512, "z" * 511 + "y"), ("", "")]
    df = spark.createDataFrame(data, "a string, b string")
    got = [tuple(r[0]) for r in df.select(compare.bytes_diff(F.col("a"), F.col("b"))).collect()]
    assert got == [(False, 4, 4, 3), (False, 2, 3, None), (True, 1, 1, None), (False, None, 0, None), (True, None, None, None), (False, 1401, 1401, 1400), (False, 512, 512, 511), (True, 0, 0, None)]


def test_cell_diff_of_lone_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "z"), (3, "y")], "k int, v string")
    assert rows(compare.cell_diff(a, b, ["k"], ["v"])) == [(1, "v", "x", "z"), (2, None, "row", None), (3, None, None, "row")]


def test_rendering(spark):
    one = spark.sql("select 0.3751454883084359d v, cast(2.675 as decimal(10,3)) h, 1234567 i, 9.996d c")
    got = one.select(render.fixed(F.col("v"), 2), render.fixed(F.col("h"), 2), render.grouped(F.col("i")), render.scientific(F.col("c"), 3)).first()
    assert tuple(got) == ("0.38", "2.68", "1,234,567", "1.00e1")
    some = spark.createDataFrame([(9.996,), (0.012345,), (123456.0,), (0.0,)], "v double")
    assert [r[0] for r in some.select(render.significant(F.col("v"), 3)).collect()] == ["10.0", "0.0123", "123000", "0.00"]
    spelled = spark.sql("select 1 x").select(render.forms([F.lit("1.300"), F.lit("0.010")], "plus_minus")).first()[0]
    assert spelled == ["1.300 ± 0.010", "1.300 +/- 0.010"]


def test_rendering_by_exact_value(spark):
    """Doubles by their binary value, decimals by their digits; any size; no sign before a zero."""
    df = spark.createDataFrame([(2.675, -0.001, 1e300, 25.0), (float("nan"), None, 5e-324, -35.0)], "a double, b double, c double, d double")
    got = df.select(*(render.fixed(F.col(c), 2) for c in "ab"), render.significant(F.col("c"), 2), render.scientific(F.col("c"), 17), render.half_even(F.col("d"), -1)).collect()
    assert tuple(got[0])[:2] == ("2.67", "0.00") and got[0][2] == "1" + "0" * 300 and got[0][3] == "1.0000000000000001e300" and got[0][4] == 20
    assert tuple(got[1])[:2] == (None, None) and got[1][2] == "0." + "0" * 323 + "49" and got[1][3] == "4.9406564584124654e-324" and got[1][4] == -40
    exact = spark.sql("select cast(12345678901234567890.12345 as decimal(38,5)) v, cast(0 as decimal(5,2)) z")
    got = exact.select(render.fixed(F.col("v"), 2), render.scientific(F.col("v"), 20), render.scientific(F.col("z"), 3), render.significant(F.col("z"), 3)).first()
    assert tuple(got) == ("12345678901234567890.12", "1.2345678901234567890e19", "0.00e0", "0.00")


def test_closed_grammars(spark):
    words = "7 007 +7 -7 -0 1.5 .5 5. 1e5 1E-05 inf NaN true x 2024-01-01 --7 (≈5) k=5 7pH 0123456789ab 5%".split()
    df = spark.createDataFrame([(w,) for w in words], "w string")
    w = F.col("w")
    got = {r[0]: r[1:] for r in df.select(w, render.is_number(w, "integer"), render.is_number(w, "decimal"), render.cell_type(w), render.numeric_expression(w)).collect()}
    assert {x for x in words if got[x][0]} == {"7", "-7", "-0"}
    assert {x for x in words if got[x][1]} == {"7", "-7", "-0", "1.5", "1e5", "1E-05"}
    assert {x for x in words if got[x][2] == "integer"} == {"7", "+7", "-7", "-0"}
    assert {x for x in words if got[x][2] == "float"} == {"1.5", ".5", "5.", "1e5", "1E-05", "inf", "NaN"} and got["007"][2] == "text"
    assert {x for x in words if got[x][3]} == {"7", "007", "+7", "-7", "-0", "1.5", ".5", "5.", "1e5", "1E-05", "(≈5)", "5%"}
    with pytest.raises(ValueError):
        render.forms([w], "tuple")


def test_exact_float(spark):
    got = spark.sql("select 0.1d v union all select double('nan')").select(render.exact_float(F.col("v"))).collect()
    assert sorted(str(r[0]) for r in got) == ["0.1000000000000000055511151231257827021181583404541015625", "None"]


def test_reach_components_levels(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (3, 1), (5, 6)], "src long, dst long")
    seeds = spark.createDataFrame([(4,)], "node long")
    assert rows(reach(seeds, e)) == [(4, 0), (5, 1), (6, 2)]
    assert rows(components(e)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4)]
    done, left = levels(e)
    assert rows(done) == [(4, 0), (5, 1), (6, 2)]
    assert rows(left) == [(1,), (2,), (3,)]


def test_reach_says_when_it_is_too_deep(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    with pytest.raises(RuntimeError):
        reach(spark.createDataFrame([(0,)], "node long"), chain, depth=3)


def test_ancestors(spark):
    assert spark.sql("select 'a/b/c' p").select(ancestors(F.col("p"))).first()[0] == ["a", "a/b", "a/b/c"]


def test_glob_and_front_matter(spark):
    import re

    assert re.match(files.glob_regex("a/*.c?v"), "a/x.csv") and not re.match(files.glob_regex("a/*"), "a/b/c")
    m = spark.sql("select '---\nk: v\nx: y\n---\nbody' t").select(files.front_matter(F.col("t"))).first()[0]
    assert m == {"k": "v", "x": "y"}


def test_delimited_rejects_ragged_rows_and_wrong_headers(spark):
    path = shared_path(spark, "csv")
    spark.createDataFrame([("a,b",), ("1,2",), ("3",), ("4,5,6",)], "value string").coalesce(1).write.text(path)
    good, bad = files.read_delimited(spark, path, ["a", "b"])
    assert rows(good) == [("1", "2")] and len(bad.collect()) == 2
    with pytest.raises(ValueError):
        files.read_delimited(spark, path, ["a", "c"])


def test_slots_are_replaced_alone(spark):
    path = shared_path(spark, "slots")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, slot string")
    sinks.publish_slots(df, path)
    sinks.publish_slots(df.where("slot = 'b'").withColumn("v", F.lit(9)), path)
    assert rows(spark.read.parquet(path)) == [(1, "a"), (9, "b")]


def test_rendering_of_decimals_runs_no_python(spark, capsys):
    spark.range(3).select(render.fixed(F.col("id").cast("decimal(10,3)"), 2), render.half_even(F.col("id"), -1)).explain()
    assert "Python" not in capsys.readouterr().out
