"""Delimited files by position, JSON texts by path, fenced blocks."""

import json

from proofframe.operators.tables import table_differences
from proofframe.sources import delimited, fences, json_text
from proofframe.storage import shared_path


def side(spark, *files):
    path = shared_path(spark, "delimited")
    for i, text in enumerate(files):
        spark.createDataFrame([(line,) for line in text.splitlines()], "t string").coalesce(1).write.text(f"{path}/f={i:02d}")
    return delimited.positioned(spark, path)


def found(a, b, **options):
    return sorted(map(tuple, table_differences(a, b, **options).collect()), key=lambda r: (r[0], r[1] or 0))


CASES = [
    ("x,y\n1,true\n", "x,y\n1,false\n", [(2, 2, "value", "true", "false")]),
    ("x\n1\n", "x\n01\n", [(2, 1, "type", "1", "01")]),
    ("x\n1\n", "x\n1.0\n", [(2, 1, "type", "1", "1.0")]),
    ("x\nnan\nTrue\n+7\n1e1\n", "x\nNaN\ntrue\n7\n10.0\n", []),
    ("x\n0.0\n-0\ninf\n", "x\n-0.0\n0\nInfinity\n", [(2, 1, "value", "0.0", "-0.0")]),
    ("x,y\n1,2\n", "x,y\n1,2,3\n", [(2, None, "width", "2", "3")]),
    ("1,0.0\n", "1,-0.0\n", [(1, 2, "value", "0.0", "-0.0")]),
    ('a,"b, ""c"""\n', 'a,"b, ""d"""\n', [(1, 2, "value", 'b, "c"', 'b, "d"')]),
    ('a,"b"c\n', "a,bc\n", [(1, None, "malformed", 'a,"b"c', "a,bc")]),
    ("a,,b\n,\n", "a,,b\n,x\n", [(2, 2, "type", "", "x")]),
    ("99999999999999999999999999999999999999999\n", "99999999999999999999999999999999999999998\n", [(1, 1, "value", "9" * 41, "9" * 40 + "8")]),
]


def test_table_differences(spark):
    """A file for each case; rows keep their positions in all."""
    want, at = [], 0
    for a, _, differences in CASES:
        want += [(at + p, *rest) for p, *rest in differences]
        at += len(a.splitlines())
    assert found(side(spark, *(a for a, *_ in CASES)), side(spark, *(b for _, b, _ in CASES))) == want


def test_an_inserted_row_moves_the_rest(spark):
    assert found(side(spark, "x\n1\n2\n"), side(spark, "x\n0\n1\n2\n")) == [(2, 1, "value", "1", "0"), (3, 1, "value", "2", "1"), (4, None, "availability", None, "row")]


def test_headers_are_text(spark):
    assert found(side(spark, "1\n5\n"), side(spark, "1.0\n5\n"), header=True) == [(1, 1, "value", "1", "1.0")]


def test_positions_over_files_and_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        rows = side(spark, "".join(f"a{i:04d},\n" for i in range(300)), "b\n", "", "".join(f"c{i}\n" for i in range(90)))
        got = [(r["position"], r["row"], r["cells"][0]) for r in rows.orderBy("position").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    names = [f"a{i:04d}" for i in range(300)] + ["b"] + [f"c{i}" for i in range(90)]
    own = [*range(1, 301), 1, *range(1, 91)]
    assert got == list(zip(range(1, 392), own, names, strict=True))


JSON = [
    ('{"x": [1, 2]}', '{"x": [1, 3]}', [('$["x"][1]', "2", "3")]),
    ('{"x": 0.0}', '{"x": -0.0}', [('$["x"]', "0.0", "-0.0")]),
    ('{"x": 1}', '{"x": 1.0}', [('$["x"]', "1", "1.0")]),
    ('{"x": 1}', '{"x": "1"}', [('$["x"]', "1", '"1"')]),
    ('{"x": 1}', '{"x": true}', [('$["x"]', "1", "true")]),
    ('{"x":1, "y":2}', '{"y":2, "x":1}', []),
    ('{"x": {"b": 1, "a": 2}}', '{"x": {"b": 1}}', [('$["x"] keys', '["a", "b"]', '["b"]')]),
    ("[1, 2, 3]", "[2, 3]", [("$ length", "3", "2")]),
    ('{"k":2,"k":3}', '{"k":3}', [("$", "duplicate_key", '{"k": 3}')]),
    ("[NaN]", "[1e999]", [("$", "non_finite", "non_finite")]),
    ("{", None, [("$", "malformed", "missing")]),
    ("﻿1", "1", [("$", "byte_order_mark", "1")]),
    ("[" * 100_000, "[]", [("$", "too_deep", "[]")]),
    ("{", "{", []),
    ("1" * 60, "1" * 59 + "2", [("$", "1" * 60, "1" * 59 + "2")]),
    ('{"a":' * 8 + "1" + "}" * 8, '{"a":' * 8 + "2" + "}" * 8, [("$" + '["a"]' * 8, "1", "2")]),
]


def test_json_differences(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(JSON)], "path int, a string, b string")
    got = {}
    for r in json_text.json_differences(df.withColumnRenamed("path", "id"), "a", "b", "id").collect():
        got.setdefault(r["id"], []).append((r["path"], r["expected"], r["found"]))
    assert [got.get(i, []) for i in range(len(JSON))] == [want for *_, want in JSON]
    assert json_text.json_differences(df.where("path < 0"), "a", "b").collect() == []


def test_json_strings(spark):
    deep = "x"
    for i in range(50):
        deep = {"k": [deep, {"n": i, "s": f"s{i}"}]}
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, "no json"), (3, None), (4, "[]"), (5, '["b", {"z": "a", "a": "b"}]')], "id int, t string")
    got = {r["id"]: r["strings"] for r in json_text.json_strings(df, "t", "id").collect()}
    assert got == {1: ["x"] + [f"s{i}" for i in range(50)], 2: ["no json"], 3: None, 4: [], 5: ["b", "a", "b"]}


FENCES = [
    ("a\n```\nb\n```\nc", "01110"),
    ("```py\nb\n~~~\n``\n```` \t\nc", "111110"),
    ("~~~~\n~~~\n~~~~x\n~~~~~\nz", "11110"),
    ("  ```\nx", "11"),
    ("``\n``` a ```\nx", "011"),
    ("", "0"),
]


def test_fences(spark):
    long = "\n".join(["x", "```", "y", "````"] * 25_000)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FENCES)] + [(90, long), (91, None)], "id int, text string")
    got = {}
    for r in fences.fenced_lines(df, "text", "id").orderBy("id", "line_no").collect():
        got[r["id"]] = got.get(r["id"], "") + "01"[r["inside"]]
    assert got == {i: want for i, (_, want) in enumerate(FENCES)} | {90: "0111" * 25_000}
