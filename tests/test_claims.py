"""Conflicting claims as pairs."""

import datetime

import duckdb

import __spark_entry__ as entry


def test_every_conflicting_pair_is_listed(spark, tmp_path):
    at = lambda day, hour: datetime.datetime(2024, 1, day, hour)
    kinds = ["view", "purchase", "click", "signup", None, "purchase", "error"]
    rows = [(i, at(1 + i % 2, i % 24), i % 3, kinds[i % 7]) for i in range(120)] + [(500, None, 0, "purchase"), (501, at(1, 1), None, "signup"), (3, at(2, 3), 0, "purchase")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["claim_conflicts"]).fetchall()
    got = entry.queries()["claim_conflicts"](spark, str(tmp_path))
    assert got.columns == ["a", "b"] and sorted(map(tuple, got.collect())) == sorted(want)
    writes = ("purchase", "signup")
    plain = [(x[0], y[0]) for x in rows for y in rows if x[1] and y[1] and x[1].date() == y[1].date() and x[2] is not None and x[2] == y[2] and x[0] < y[0] and (x[3] in writes or y[3] in writes)]
    assert len(plain) > 300 and sorted(plain) == sorted(want)
