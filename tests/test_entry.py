"""The contract of the entry module, and some registered queries against DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SOME = ["tolerance_compare", "table_diff", "join_bridge", "unique_prior_producer", "root_rollup", "section_of_line", "fn_forms", "reachable_from_roots", "group_fingerprint", "publish_slot", "event_summary"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry_runs(spark):
    assert len(entry.entry(spark).collect()) == 12


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    names = sorted(df.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in names)} from ({entry.oracle_sql()[name]})").fetchall()
    norm = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted((norm(r) for r in df.select(names).collect()), key=repr) == sorted(map(norm, want), key=repr)
