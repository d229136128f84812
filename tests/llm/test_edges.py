"""Repeated rows, empty tables, ties and null texts through whole operators and the pipeline."""

import hashlib
import random
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from proofframe.llm import langid, mpegts, pii, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in texts], DOCS)


def prose(seed, words=40):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "river", "stone", "walks", "under", "green", "and", "old", "house", "sings"]) for _ in range(words))


def test_toxicity_of_repeats_and_long_and_empty_tables(spark):
    texts = [(i, prose(i) + (" you utter moronface" if i % 3 == 0 else "")) for i in range(60)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    long = "harmless words again " * 60_000
    rows = table(spark, [(1, "a moronface"), (1, "a moronface"), (2, long), (2, long + " mor0nface moronface"), (3, None), (4, "")])
    got = sorted((r["doc_id"], r["predicted"]) for r in toxicity.score(rows, model).collect())
    assert got == [(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (4, 0)]
    assert toxicity.score(docs.limit(0), model).collect() == []
    none = toxicity.train(docs.limit(0), labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(rows, none).collect()} == {0}


def test_media_of_repeats_by_value(spark):
    texts = [(1, "abc"), (1, "abc"), (2, None), (3, ""), (4, "x" * 64), (5, "é" * 500)]
    got = mpegts.media_digests(table(spark, texts)).collect()
    assert len(got) == 6 and mpegts.media_digests(table(spark, [])).collect() == []
    for r in got:
        text = dict(texts)[r["doc_id"]] or ""
        data = text.encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert len({tuple(r) for r in got if r["doc_id"] == 1}) == 1


def plain_accepts(pattern, weights):
    return sum(weights[name] for name in pii.features(pattern)) >= 0


def test_pii_accepts_as_plain_python_does(spark):
    weights = {n: random.Random(n).uniform(-2, 2) for n in [*pii.EXTRA, *pii.LABELERS, "several", *(f"{t}{v}" for t, n in pii.TRAITS.items() for v in range(n))]}
    r = random.Random(3)
    patterns = [(r.choice([*pii.EXTRA]), *(r.randrange(2) for _ in pii.LABELERS), *(r.randrange(n) for n in pii.TRAITS.values())) for _ in range(300)]
    names = ["kind", *pii.LABELERS, *pii.TRAITS]
    df = spark.createDataFrame(patterns, ", ".join(["kind string", *(f"{n} int" for n in names[1:])]))
    got = df.select(*names, pii.accepted(F.struct(*names), weights).alias("ok")).collect()
    assert len(got) == 300 and all(x["ok"] == plain_accepts(tuple(x[n] for n in names), weights) for x in got)


def test_pii_learns_from_candidates_that_disagree(spark):
    words = [f"{w}{v}worddddddddddd" for w in "abcdefghij" for v in "aeiou"]
    texts = [(i, f"{prose(i)} {words[i % 50]} ") for i in range(200)]
    texts += [(1000 + i, f"x password={hashlib.md5(str(i).encode()).hexdigest()[:18]} y") for i in range(8)] * 2
    texts += [(2000 + i, f"see AKIA{hashlib.md5(str(i).encode()).hexdigest()[:16].upper()} now") for i in range(8)]
    texts += [(3000, "mail jane.doe [at] example [dot] com please"), (3001, "Note: nothing"), (3002, None)]
    got = pii.digests(table(spark, texts)).collect()
    assert len(got) == len(texts)
    found = {r["doc_id"] for r in got if r["n_extra"]}
    assert found >= {*range(1000, 1008), *range(2000, 2008), 3000} and not found & {*range(200), 3001, 3002}


def test_languages_of_repeats_and_empty_tables(spark):
    docs = table(spark, [(i, prose(i)) for i in range(20)]).unionByName(table(spark, [(100 + i, "der die und das nicht " * 9) for i in range(20)], "de"))
    profiles = langid.train(docs)
    rows = table(spark, [(1, prose(99)), (1, prose(99)), (2, "nicht und das"), (3, None), (4, "1234 -")])
    assert sorted((r["doc_id"], r["lang_pred"]) for r in langid.identify(rows, profiles).collect()) == [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und")]
    assert langid.identify(docs.limit(0), profiles).collect() == [] and langid.train(docs.limit(0)) == {}


def test_urls_of_repeats_ties_and_empty_tables(spark):
    rules = url_filter.rule_table(spark, [("block", "a.org", "/x"), ("allow", "a.org", "/x"), ("block", "b.org", "/")])
    pages = spark.createDataFrame([(1, "http://a.org/x1"), (1, "http://a.org/x1"), (1, "http://www.b.org/?q"), (2, None)] + [(3, f"http://hot.b.org/{i}") for i in range(50)], "page_id long, url string")
    got = sorted((r["page_id"], r["rule"] or "", r["verdict"]) for r in url_filter.judge(pages, rules).collect())
    assert got == [(1, "a.org/x", "allow")] * 2 + [(1, "b.org/", "block"), (2, "", "allow")] + [(3, "b.org/", "block")] * 50
    assert url_filter.judge(pages.limit(0), rules).collect() == []
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_the_url_filter_is_native(spark):
    rules = url_filter.rule_table(spark, [("block", "a.org", "/x")])
    plan = url_filter.judge(spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string").cache(), rules)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan.split("InMemoryRelation")[0] for x in ("ExistingRDD", "ArrowEvalPython", "MapInArrow", "BatchEvalPython"))


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, None), (1, None)]])
def test_the_pipeline_on_next_to_nothing(spark, tmp_path, rows):
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
