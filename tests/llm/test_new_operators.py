"""Centroid clustering, importance resampling and HTML extraction against plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from proofframe.llm import centroids, html_text, resample


def plain_clusters(rows, k, rounds, scale, seed):
    kept = [(i, tuple(math.floor(scale * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), np.array(v, "<i4").tobytes(), v) for i, v in kept if i is not None)
    c = [list(v) for *_, v in first[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, members in groups.items():
            c[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    own = {}
    for _, d, j in found:
        own[j] = own.get(j, 0) + d
    return sorted(((-1 if i is None else i), j, d, own[j], sum(own.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found)


def test_bisectors_give_the_nearest_with_ties_to_the_smaller_number():
    r = np.random.default_rng(1)
    c, x = r.integers(-3, 4, (9, 2)), r.integers(-4, 5, (400, 2))
    best, away = centroids.Bisectors(c).nearest(x)
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (best == d.argmin(1)).all() and (away == d.min(1)).all()  # argmin: the first of equals


def test_clusters(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([-0.6, -0.1, 0.0, 0.3, 0.7]) + r.random() / 50 for _ in range(3)]) for i in range(150)]
    rows += [(7, rows[7][1])] * 60 + [(None, [0.5, 0.5, 0.5]), (900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [1.0, math.nan, 0.0]), (905, [math.inf, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string")
    got = centroids.cluster(df.repartition(5), k=6, rounds=4, dim=3, scale=256, seed=2)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in got.collect()) == plain_clusters(rows, 6, 4, 256, 2)


def test_clusters_of_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = centroids.cluster(spark.createDataFrame([(1, [0.1, 0.2]), (2, [-0.1, 0.3])], schema), k=5, dim=2)
    assert {(r["vec_id"], r["distance"]) for r in few.collect()} == {(1, 0), (2, 0)}
    none = centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0]), (2, None)], schema), k=5, dim=2)
    assert none.collect() == [] and none.columns == few.columns and none.dtypes == few.dtypes


def plain_features(text):
    words, word = [], ""
    for ch in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "") + " ":
        if ch.isdigit() and ch.isascii() or "a" <= ch <= "z" or ord(ch) > 127:
            word += ch
        elif word:
            words.append(word)
            word = ""
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def plain_resample(docs, target, buckets):
    def count(texts):
        out = [0] * buckets
        for t in texts:
            for f in plain_features(t)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = count(x for _, x in docs), count(target)
    gain = [math.floor(1000 * math.log((float(b + 1) * float(sum(s) + buckets)) / (float(a + 1) * float(sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, x in docs:
        words, f = plain_features(x)
        w = math.floor(sum(gain[zlib.crc32(y.encode()) % buckets] for y in f) / len(f)) if f else 0
        h = None if i is None else int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, None if h is None else w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    able = sorted((r for r in out if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0], r[2], r[1]))
    for rank, row in enumerate(able[: len(able) * 25 // 100], 1):
        row[4] = rank
    return sorted((r[:5] for r in out), key=repr)


def test_resampling(spark, monkeypatch):
    monkeypatch.setattr(resample, "PIVOTS", 3)
    r = random.Random(5)
    vocabulary = ["Ça", "the", "OF", "x1", "straße", "a", "Привет", "fin", "data", "set"]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randrange(50)))) for i in range(230)]
    docs += [(5, docs[5][1])] * 90 + [(None, "the " * 30), (501, None), (502, ""), (503, "--- \n"), (504, "one.two,three;FOUR\t" * 40)]
    target = ["the data set of the fin", None, "", "data set data set"]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, rank int").repartition(4)
    got = resample.resample(d, spark.createDataFrame([(t,) for t in target], "text string"), buckets=97)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted((list(x) for x in got.collect()), key=repr) == plain_resample(docs, target, 97)


def test_resampling_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(empty, empty).collect() == []
    one = resample.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), empty).first()
    assert one["n_features"] == 3 and one["rank"] is None


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = ("Über " + "x" * 40 + " yz, 9 " * 30).encode()
    whole = [b for _, x in resample.Buckets(3, 1000).runs(text) for b in x]
    monkeypatch.setattr(resample, "PIECE", 7)
    cut = list(resample.Buckets(3, 1000).runs(text))
    assert len(cut) > 5 and sorted(b for _, x in cut for b in x) == sorted(whole)


@pytest.mark.parametrize("k", [1, 2, 50, 99, 100, 101])
def test_kth_key(spark, k):
    r = random.Random(k)
    rows = [(r.randrange(6), r.randrange(12)) for _ in range(100)]
    want = sorted(rows, key=lambda x: (-x[0], x[1]))
    got = resample.kth_key(spark.createDataFrame(rows, "score long, doc_id long"), k)
    assert got == (want[k - 1] if k <= 100 else None)


GOOD = "This is the kind of prose that a page is for, and it goes on for as long as it has to, with the words of the language in it."
JUNK = "Lorem ipsum dolor amet consectetur adipiscing elit nullam feugiat vivamus sodales tincidunt praesent ultricies."

PAGES = [
    ("<p>one<p>two <b>bold</b>ness<br>three", "one two boldness three"),
    (f"<html><head><title>t</title><body><nav><a href=x>menu</a> of all</nav><p>Short.</p><p>{GOOD}</p><footer>the end of it</footer>", f"Short. {GOOD}"),
    (f"<body><p>{GOOD}</p><p>Near.</p><p>{JUNK}</p><p>Far.</p></body>", f"{GOOD} Near."),
    (f'<article><header><h1>T</h1></header><p>a &amp; b&nbsp;&#x63;</p><p>{JUNK}</p><aside>no</aside><p class="cookie-notice">no</p></article><section id="comments"><article>{GOOD}</article></section>', f"T a & b c {JUNK}"),
    ('<div class="ad">x<article><p>yes</p></article>', "yes"),
    ('<div class="page with-sidebar"><div class="userComments">no</div>yes</div>', "yes"),
    (f'<article><p>{GOOD}</p><ul><li><a href="/a">Read this</a><li><a href="/b">Read that</a></ul><p>End.</p></article>', f"{GOOD} End."),
    ("<script>var a='<p>no</p>'</script><style>p{}</style>ok<!-- <p>no --> then", "ok then"),
    ("<form><p>all in a form</p></form>", "all in a form"),
    (f"<form><input><label>no</label></form><p>{GOOD}</p>", GOOD),
    ('text < 3 & 5 <3 </> <a title="never closed', "text < 3 & 5 <3"),
    ("<head><title>no</title><p>yes", "yes"),
    ("<ul><li>a<li>b</ul><table><tr><td>1</section><td>2</table>", "a b 1 2"),
    ("", ""),
    (None, ""),
    ("<div hidden>no</div><div style='display: none'>no</div>", ""),
]


def test_html(spark):
    rows = [(i, f"http://a/{i}", h, "x") for i, (h, _) in enumerate(PAGES)] + [(0, None, PAGES[0][0], "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    for r in got.collect():
        assert r["text"] == PAGES[r["page_id"]][1], r
        assert r["n_chars"] == len(r["text"])
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_second_pass_takes_after_the_nearest():
    u, g, b = "unsure", "good", "bad"
    assert html_text.second_pass([u, u, g, u, b, u, u], [0] * 7) == [True, True, True, True, False, False, False]
    assert html_text.second_pass([b, u, u, g], [0] * 4) == [False, False, True, True]
    assert html_text.second_pass([u, u], [0, 1]) == [True, True]
    assert html_text.second_pass([b, u], [1, 0]) == [False, True]


def test_long_pages_take_time_in_proportion():
    import time

    def took(n):
        began = time.process_time()
        html_text.main_text('<p class="x>' * n + "<div>" * n + "</section>" * n + "<b>" * n + "&" * n)
        return time.process_time() - began

    took(2000)
    assert took(40_000) < 30 * max(took(4000), 0.01)
