"""Chains of more than 64 events, against the queries' own SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from proofframe.operators.fixpoint import reach
from proofframe.storage import shared_path


@pytest.fixture(scope="module")
def folder(spark):
    """One user with 150 events in a day, some at the same time, and others with few."""
    kinds = ["view", "purchase", "error", "signup", "view", "purchase", "view"]
    rows = [(1000 - i, 7, f"2024-05-01 08:{i // 3:02}:00", kinds[i % 7]) for i in range(150)]
    rows += [(2000 + i, i % 5, f"2024-05-0{1 + i % 2} 23:{59 - i:02}:00", kinds[(i * 5) % 7]) for i in range(40)]
    path = shared_path(spark, "long-chains")
    spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string").selectExpr("event_id", "user_id", "cast(ts as timestamp_ntz) ts", "event_type").write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["root_blockers", "propagate_blockers", "propagate_required", "blocked_closure", "primary_cause"])
def test_long_chains(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    df = entry.queries()[name](spark, folder)
    names = sorted(df.columns)
    want = con.execute(f"select {', '.join(names)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(names).collect())) == sorted(want) and len(want) > 30


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name", ["root_blockers", "propagate_blockers", "propagate_required", "blocked_closure", "primary_cause"])
def test_given_events(spark, name):
    con = duckdb.connect()
    con.execute("create view events as select * from '/root/testdata/sf0.001/events.parquet'")
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    names = sorted(df.columns)
    want = con.execute(f"select {', '.join(names)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(names).collect())) == sorted(want)


def test_reach_has_no_limit_of_its_own(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "src long, dst long").coalesce(1)
    got = reach(spark.createDataFrame([(0,)], "node long"), chain)
    assert sorted(map(tuple, got.collect())) == [(i, i) for i in range(71)]
