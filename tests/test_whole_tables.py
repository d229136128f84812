"""All vectors, customers and suppliers, against brute force."""

import pytest

import __spark_entry__ as entry
from proofframe.storage import shared_path


@pytest.fixture(scope="module")
def folder(spark):
    path = shared_path(spark, "whole-tables")
    for name, schema, rows in [
        ("embeddings", "vec_id long, embedding array<float>", [(i, [float(i + j) for j in range(64 if i % 9 else 63)]) for i in range(45, 60)]),
        ("region", "r_regionkey int", [(i,) for i in range(2)]),
        ("nation", "n_nationkey int, n_regionkey int", [(i, i % 2) for i in range(5)]),
        ("customer", "c_custkey long, c_nationkey int", [(i, i % 4) for i in range(1, 57)]),
        ("orders", "o_orderkey long, o_custkey long", [(1, 1)]),
        ("supplier", "s_suppkey long, s_nationkey int", [(i, i % 5) for i in range(1, 81)]),
    ]:
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def got(spark, name, folder):
    return sorted(tuple(r) for r in entry.queries()[name](spark, folder).collect())


def test_align_arrays_takes_all_vectors(spark, folder):
    whole = got(spark, "align_arrays", folder)
    assert whole == sorted((i, j, (j + 1) * 10, float(i + j)) for i in range(45, 60) if i % 9 for j in range(64))


def test_holders_of_all_customers(spark, folder):
    whole = got(spark, "holders_of_target", folder)
    assert whole == sorted((f"customer:{i}", f"region:{i % 4 % 2}") for i in range(1, 57))


def test_attach_scoped_has_all_blockers(spark, folder):
    pairs = {(i, b) for i in range(1, 57) for b in range(1, 81) if b % 10 == 0 or (b % 10 < 4 and i % 4 == b % 5) or (b % 10 >= 4 and i == b)}
    rows = entry.queries()["attach_scoped"](spark, folder).collect()
    spread = [(i, r["blocker"]) for r in rows for i in range(1, 57) if r["scope"] == "log" or r["c_nationkey"] == i % 4 or r["c_custkey"] == i]
    assert len(spread) == len(pairs) == sum(r["customers"] for r in rows) and set(spread) == pairs
    assert {r["blocker"] for r in rows} == {b for _, b in pairs}
