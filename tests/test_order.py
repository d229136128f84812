"""Global ranks and running sums."""

import random

from pyspark.sql import functions as F

from proofframe.operators.order import placed, ranked, running


def test_ranks_with_ties_nulls_and_clashing_names(spark):
    r = random.Random(1)
    data = [(r.choice([None, 1, 2, 3]), i, "x") for i in range(400)]
    df = spark.createDataFrame(data, "k int, part int, Place string").repartition(5)
    got = ranked(df, [F.col("k"), F.col("part")], "rank")
    assert got.columns == ["k", "part", "Place", "rank"]
    want = sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [(x["k"], x["part"], x["rank"]) for x in got.orderBy("rank").collect()] == [(k, i, n) for n, (k, i, _) in enumerate(want, 1)]


def test_running_sums_of_a_group_that_spans_all_parts(spark):
    r = random.Random(2)
    data = [("hot" if r.random() < 0.8 else r.choice(["a", "b", None]), i, r.choice([None, 1, 5])) for i in range(600)]
    df = spark.createDataFrame(data, "g string, k int, total int").repartition(7)
    rows, part, _ = placed(df, [F.col("g"), F.col("k")])
    assert rows.where("g = 'hot'").select(part).distinct().count() > 1  # the case that matters
    got = running(df, ["g"], [F.col("k")], F.col("total"), "sum").collect()
    at, want = {}, {}
    for g, k, v in sorted(data, key=lambda x: x[1]):
        at[g] = want[g, k] = at.get(g, 0) + (v or 0)
    assert len(got) == 600 and {(x["g"], x["k"]): x["sum"] for x in got} == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "g string, k int")
    assert ranked(empty, [F.col("k")]).collect() == []
    assert running(empty, ["g"], [F.col("k")], F.lit(1), "n").collect() == []
