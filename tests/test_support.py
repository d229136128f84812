"""Covering records, directory inputs, neighbourhoods, folders member by member, kinds of files, the tee."""

import random
import time

import pytest
from pyspark.sql import functions as F

from proofframe.operators.fixpoint import neighbourhood
from proofframe.operators.members import member_differences
from proofframe.operators.support import currentness, directory_inputs, resolved
from proofframe.sources import files
from proofframe.storage import shared_path
from proofframe.streaming import traces


def test_records_of_their_own_or_of_the_one_directory_around(spark):
    materials = spark.createDataFrame([(1, "a/b/x", "f1", "s"), (2, "a/b/y", "f2", "s"), (3, "a/c/z", "f3", "s"), (4, "q", "f4", "s"), (5, "a/b/x", "f5", "s")], "id int, path string, fingerprint string, script string")
    columns = "path string, fingerprint string, script string, confirmed boolean"
    records = spark.createDataFrame([("a/b/x", "f1", "s", True), ("q", "f4", "t", False)], columns)
    directories = spark.createDataFrame([("a/b", "d", "old", True), ("a/c", "e", "s", True), ("a", "g", "s", True)], columns)
    found = resolved(materials, records, directories.where("path <> 'a'"), "id")
    got = {r["id"]: (r["how"], r["record"] and r["record"]["path"]) for r in found.collect()}
    assert got == {1: ("exact", "a/b/x"), 2: ("directory", "a/b"), 3: ("directory", "a/c"), 4: ("exact", "q"), 5: ("exact", "a/b/x")}
    now = found.withColumn("covering_fingerprint", F.lit("e"))
    got = {r["id"]: (r["state"], r["mismatches"]) for r in currentness(now, ["fingerprint", "script"]).collect()}
    assert got == {1: ("current", None), 2: ("mismatch", ["fingerprint", "script"]), 3: ("current", None), 4: ("unconfirmed", None), 5: ("mismatch", ["fingerprint"])}
    assert {r["id"]: r["how"] for r in resolved(materials, records, directories, "id").collect()}[2] == "ambiguous"
    assert {r["id"]: r["how"] for r in resolved(materials, records, directories.limit(0), "id").collect()}[2] == "none"


def plain_inputs(consumers, outputs, made):
    for c, seq, d, member in consumers:
        owners = {p for p, s, x in made if s < seq and (d == x or d.startswith(x + "/"))}
        inside = {p for p, s, x in outputs + made if s < seq and x.startswith(d + "/")}
        one = min(owners) if len(owners) == 1 else None
        missing = one is not None and not any(p == one and x == member for p, _, x in outputs)
        clash = len(inside - owners)
        yield c, len(owners), clash, one, missing, "no_owner" if not owners else "several_owners" if len(owners) > 1 else "conflict" if clash else "missing_member" if missing else "valid"


def test_directory_inputs_against_all_pairs(spark):
    r = random.Random(4)
    paths = ["a", "a/b", "a/b/c", "a/bb", "d", "d/e"]
    made = [(r.choice("pqrs"), r.randrange(40), r.choice(paths)) for _ in range(12)]
    outputs = [(r.choice("pqrs"), r.randrange(40), r.choice(paths) + r.choice(["/x", "/y", "/b/z"])) for _ in range(25)]
    consumers = [(i, r.randrange(40), d := r.choice(paths), d + "/x") for i in range(80)]
    frames = [spark.createDataFrame(x, s) for x, s in ((consumers, "consumer long, seq int, directory string, member string"), (outputs, "producer string, seq int, path string"), (made, "producer string, seq int, path string"))]
    got = sorted((x["consumer"], x["owners"], x["conflicts"], x["owner"], x["missing"], x["verdict"]) for x in directory_inputs(*frames).collect())
    want = sorted(plain_inputs(consumers, outputs, made))
    assert got == want and len({w[-1] for w in want}) >= 3


def test_neighbourhood_through_ambiguities(spark):
    edges = [("command:1", "file:a"), ("file:a", "command:2"), ("command:2", "file:b"), ("file:z", "command:9"), ("command:3", "file:y")]
    e = spark.createDataFrame(edges, "src string, dst string")
    a = spark.createDataFrame([("ambiguity:1", "file:b"), ("ambiguity:1", "file:z"), ("ambiguity:1", "command:3"), ("ambiguity:2", "file:q")], "ambiguity string, node string")
    seeds = spark.createDataFrame([("file:a",)], "node string")
    got = {r["node"] for r in neighbourhood(seeds, e, a, F.col("src").startswith("command:")).collect()}
    # the seed's hop finds both commands; command 2 finds file b, its ambiguity file z (no command: stops) and command 3
    assert got == {"file:a", "command:1", "command:2", "file:b", "ambiguity:1", "file:z", "command:3", "file:y"}


def test_members_by_their_kinds(spark):
    old = [("t.txt", "a\nb\n"), ("j.json", '{"x": [1, 2]}'), ("c.csv", "x,y\n1,2\n"), ("b.bin", "abc"), ("gone", ""), ("s.bin", "ab"), ("same.csv", "x\n1\n"), ("v.tsv", "a\tb\n1\t2\n"), ("e.csv", "x\n1.0\n"), ("o.json", '{"a":1,"b":2}'), ("n.txt", "a"), ("d.json", "{}")]
    new = [("t.txt", "a\nc\n"), ("j.json", '{"x": [1, 3]}'), ("c.csv", "x,y\n1,2,3\n"), ("b.bin", "abd"), ("new", ""), ("s.bin", "abc"), ("same.csv", "x\n1\n"), ("v.tsv", "a\tb\n1\t3\n"), ("e.csv", "x\n1.00\n"), ("o.json", '{"b":2,"a":1}'), ("n.txt", "a\n"), ("d.json", '{"a":1,"a":1}')]
    frames = [spark.createDataFrame(x, "name string, content string") for x in (old, new)]
    got = {r["name"]: (r["location"], r["expected"], r["found"]) for r in member_differences(*frames).collect()}
    assert got == {
        "t.txt": ("line 2", "b", "c"), "j.json": ('$["x"][1]', "2", "3"), "c.csv": ("row 2 width", "2", "3"), "b.bin": ("byte 2", "63", "64"), "gone": ("members", "member", None), "new": ("members", None, "member"),
        "s.bin": ("size", "2", "3"), "v.tsv": ("row 2 column 2 value", "2", "3"), "n.txt": ("line 2", None, ""), "d.json": ("$", "{}", "duplicate_key"),
    }


def test_kinds_of_files(spark, tmp_path):
    for name, content in {"a.JSON": b"{}", "b.h5": bytes.fromhex(files.HDF5_MAGIC), "c.pkl": bytes.fromhex(files.HDF5_MAGIC), "d.npz": b"PK\x03\x04", "e.npz": b"x", "f.pickle": b"x", "g": b"PK\x03\x04", "h.tar.csv": b"x", "i.zip": b"PK\x03\x04"}.items():
        (tmp_path / name).write_bytes(content)
    rows = files.classified_files(spark, str(tmp_path), F.when(F.col("path").endswith("csv"), "tsv"))
    got = {r["path"].rpartition("/")[2]: (r["observed"], r["problem"]) for r in rows.collect()}
    assert got == {
        "a.JSON": ("json", None), "b.h5": ("hdf5", None), "c.pkl": ("hdf5", None), "d.npz": ("npz", None), "e.npz": (None, "unsupported"), "f.pickle": (None, "unsafe"), "g": (None, "unsupported"),
        "h.tar.csv": ("csv", "mismatch"), "i.zip": (None, "unsupported"),
    }


def stream(spark, path, rows):
    spark.createDataFrame(rows, "k int").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("k int").parquet(path)


def test_a_tee_goes_on_where_it_stopped(spark):
    path, kept, state = (shared_path(spark, x) for x in ("source", "kept", "state"))
    calls, fail = [], [True]

    def counted(batch, number):
        calls.append(number)

    def required(batch, number):
        traces.by_batch(kept)(batch, number)
        if fail[0]:
            raise OSError("lost")

    def optional(batch, number):
        raise OSError("full")

    sinks = {"count": (counted, True), "optional": (optional, False), "keep": (required, True)}
    df = stream(spark, path, [(1,), (2,)])
    with pytest.raises(Exception, match="lost"):
        traces.tee(df, sinks, state)
    fail[0] = False
    status = traces.tee(df, sinks, state)  # the batch comes again: only what lacks it sees it
    assert calls == [0] and status == {"count": "complete", "optional": 'failed: "full"', "keep": "complete"}
    assert sorted(r["k"] for r in spark.read.parquet(kept).collect()) == [1, 2]
    stream(spark, path, [(3,)])
    assert traces.tee(df, sinks, state)["optional"] == 'failed: "full"' and calls == [0, 1]
    assert sorted(r["k"] for r in spark.read.parquet(kept).collect()) == [1, 2, 3]
    assert not spark._jsc.getPersistentRDDs()


def test_the_tee_has_one_deadline(spark):
    path, state = shared_path(spark, "source"), shared_path(spark, "state")
    late = []
    sinks = {"slow": (lambda batch, number: time.sleep(4), False), "late": (lambda batch, number: late.append(number), False)}
    with pytest.raises(Exception, match="no time is left|did not end in time"):
        traces.tee(stream(spark, path, [(1,)]), sinks, state, timeout=3)
    assert not late
