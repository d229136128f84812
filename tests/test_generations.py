"""Results kept from run to run."""

import pytest
from pyspark.sql import functions as F

from proofframe.operators.generations import Generations, refreshed
from proofframe.storage import exists, shared_path

SCHEMA = "id long, size int, digest string, reused boolean"


def hashed(df):
    return df.select("id", "size", F.sha2("text", 256).alias("digest"))


def docs(spark, rows):
    return spark.createDataFrame(rows, "id long, text string").withColumn("size", F.length("text"))


def run(cache, df):
    rows, n = refreshed(cache, df, ["id"], ["size"], hashed, ["digest"])
    return {r["id"]: r["reused"] for r in rows.collect()}, n


def test_only_what_changed_is_computed(spark):
    cache = Generations(spark, shared_path(spark, "cache"), SCHEMA)
    assert cache.latest() == 0 and cache.read().collect() == []
    first = docs(spark, [(i, "x" * i) for i in range(50)] + [(90, None), (91, "gone")])
    assert run(cache, first) == ({**dict.fromkeys(range(50), False), 90: False, 91: False}, 52)
    second = docs(spark, [(i, "x" * (i + (i % 10 == 0))) for i in range(50)] + [(90, None), (92, "new")])
    reused, n = run(cache, second)
    assert n == 6 and sorted(i for i, r in reused.items() if not r) == [0, 10, 20, 30, 40, 92] and 91 not in reused
    assert run(cache, second)[1] == 0
    digests = {r["id"]: r["digest"] for r in cache.read().collect()}
    assert digests == {r["id"]: r["digest"] for r in hashed(second).collect()}
    assert cache.latest() == 3 and not exists(spark, f"{cache.path}/generation=1") and cache.read(2).count() == 52


def test_a_run_that_dies_leaves_the_old_generation(spark):
    cache = Generations(spark, shared_path(spark, "cache"), SCHEMA)
    one = docs(spark, [(1, "a"), (2, "bb")])
    run(cache, one)
    cache.write(cache.read().where("id = 1"), 2)  # written, and killed before it counted
    assert cache.latest() == 1 and cache.read().count() == 2

    def broken(df):
        return hashed(df.withColumn("text", F.raise_error(F.lit("killed")).cast("string")))

    with pytest.raises(Exception, match="killed"):
        refreshed(cache, docs(spark, [(1, "a"), (2, "ccc")]), ["id"], ["size"], broken, ["digest"])
    assert cache.latest() == 1 and cache.read().count() == 2
    assert run(cache, one) == ({1: True, 2: True}, 0)


def test_an_empty_table_evicts_all(spark):
    cache = Generations(spark, shared_path(spark, "cache"), SCHEMA)
    run(cache, docs(spark, [(1, "a")]))
    assert run(cache, docs(spark, [])) == ({}, 0) and cache.latest() == 2
