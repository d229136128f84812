"""Cycles, components and levels against plain walks."""

import random

import pytest

from proofframe.operators import components as star
from proofframe.operators import cycles as scc
from proofframe.operators.fixpoint import levels


def plain(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set())
    reach = {}
    for n in near:
        seen, todo = set(), list(near[n])
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += near[x]
        reach[n] = seen
    return sorted((n, min(m for m in reach[n] if n in reach[m])) for n in near if n in reach[n])


def found(spark, edges, kind="long"):
    return sorted(map(tuple, scc.cycles(spark.createDataFrame(edges, f"src {kind}, dst {kind}")).collect()))


@pytest.fixture(params=["one task", "joins"])
def way(request, monkeypatch):
    if request.param == "joins":
        monkeypatch.setattr(scc, "TASK_EDGES", 0)
        monkeypatch.setattr(star, "TASK_EDGES", 0)
    return request.param


def test_a_node_between_two_cycles_is_on_none(spark, way):
    edges = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (7, 7), (5, 7), (1, 2), (None, 1), (6, None)]
    assert found(spark, edges) == [(1, 1), (2, 1), (4, 4), (5, 4), (7, 7)]
    assert found(spark, [("b", "a"), ("a", "b"), ("b", "c")], "string") == [("a", "a"), ("b", "a")]
    assert found(spark, []) == []


def test_chains_and_rings_of_any_length(spark, way):
    n = 500 if way == "one task" else 40
    chain = [(i, i + 1) for i in range(n)]
    assert found(spark, chain) == []
    tail = [(n, n + 1), (n + 1, n + 2)]
    assert found(spark, [*chain, (n, 0), *tail]) == [(i, 0) for i in range(n + 1)]


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, way, seed):
    r = random.Random(seed)
    n = 12 + 10 * seed
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(int(n * (1 + 0.4 * seed)))]
    assert found(spark, edges) == plain(edges)


def test_components(spark, way):
    edges = [(5, 4), (4, 3), (9, 8), (7, 7), (None, 1)] + [(100 + i, 101 + i) for i in range(70)]
    got = dict(map(tuple, star.components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == {5: 3, 4: 3, 3: 3, 9: 8, 8: 8, 7: 7} | {100 + i: 100 for i in range(71)}


def test_levels_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(80)] + [(200, 201), (201, 200), (201, 202)]
    done, left = levels(spark.createDataFrame(chain, "src int, dst int"))
    assert sorted(map(tuple, done.collect())) == [(i, i) for i in range(81)]
    assert sorted(r[0] for r in left.collect()) == [200, 201, 202]
