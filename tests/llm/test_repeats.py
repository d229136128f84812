"""Rows that repeat: none of the pairwise steps may grow with the square of their number."""

import time

from proofframe.llm import sigtree


def test_near_copies_on_many_rows_of_one_id(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join([*words[:59], "other"])
    rows = [(i, t) for i, t in ((1, a), (2, b), (None, a), (None, b)) for _ in range(5000)] + [(9, "quite another text of some words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    began = time.time()
    got = sigtree.JaccardJoin(width=3).groups(df).groupBy("doc_id", "component_id").count().collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == [("1", 1, 5000), ("2", 1, 5000), ("9", 9, 1), ("None", 1, 10000)]
    assert time.time() - began < 120
    assert sigtree.JaccardJoin(width=3).deduplicated(df.where("doc_id is not null")).count() == 2


def test_busy_classes_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(sigtree, "TASK_PAIRS", 3)
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*words[:i], f"x{i}", *words[i + 1 :]])) for i in range(40)]
    df = spark.createDataFrame([(0, " ".join(words)), *((i + 1, t) for i, t in rows)], "doc_id long, text string")
    assert {r["component_id"] for r in sigtree.JaccardJoin(width=1).groups(df).collect()} == {0}
