"""Long walks and rounds of contraction: what they send by way of the driver, and what they drop on the way."""

import random

import pytest

from proofframe.operators import cycles as scc
from proofframe.operators import fixpoint


def plans_of(monkeypatch, module):
    """(label, plan) of every table that a module stores from now on."""
    plans, stored = [], module.stored

    def spy(df, label="step", **options):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return stored(df, label, **options)

    monkeypatch.setattr(module, "stored", spy)
    return plans


def test_rounds_of_contraction_broadcast_nothing(spark, monkeypatch):
    monkeypatch.setattr(scc, "TASK_EDGES", 0)
    plans = plans_of(monkeypatch, scc)
    dense = [(a, b) for a in range(4) for b in range(4) if a != b]  # no node with one edge in or out: coloured
    got = scc.cycles(spark.createDataFrame([*dense, (3, 10), (10, 11), (11, 12), (12, 11)], "src long, dst long"))
    assert sorted(map(tuple, got.collect())) == [(0, 0), (1, 0), (2, 0), (3, 0), (11, 11), (12, 11)]
    assert len(plans) > 10 and [x for x in plans if "Broadcast" in x[1]] == []
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [0, 250_000])
def test_a_long_walk_drops_edges_into_nodes_found(spark, monkeypatch, small):
    monkeypatch.setattr(fixpoint, "SMALL", small)
    monkeypatch.setattr(fixpoint, "LONG", 2)
    plans = plans_of(monkeypatch, fixpoint)
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(20)] + [(r.randrange(40), r.randrange(40)) for _ in range(25)] + [(5, 100), (100, 101), (7, None)]
    stop = {9, 100}
    depth, todo = {0: 0}, [0]
    while todo:
        todo = sorted({b for a, b in edges if a in todo and a not in stop and b is not None and b not in depth})
        depth |= dict.fromkeys(todo, max(depth.values()) + 1)
    df = spark.createDataFrame([e for e in edges if e[1] is not None], "src long, dst long").coalesce(1)
    got = fixpoint.reach(spark.createDataFrame([(0,)], "node long"), df, stop=spark.createDataFrame([(s,) for s in stop], "node long"))
    assert sorted(map(tuple, got.collect())) == sorted(depth.items()) and max(depth.values()) > 4
    assert "left" in {label for label, _ in plans}
    if not small:  # the stopping nodes alone are Spark's to join as it likes
        assert all("BroadcastHashJoin" not in plan for label, plan in plans if label == "left")
