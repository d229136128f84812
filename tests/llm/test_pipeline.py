"""The pipeline on a small folder, against plain Python."""

import base64
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from proofframe.llm.queries import WORD_BPE
from proofframe.storage import shared_path

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def grams(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def expected(texts, toxic_word):
    kept = [(i, t) for i, t in enumerate(texts) if toxic_word not in (t or "") and re.search("[a-z]", t or "")]
    label = {i: i for i, _ in kept}
    for _ in kept:
        for i, a in kept:
            for j, b in kept:
                if Fraction(len(grams(a) & grams(b)), len(grams(a) | grams(b))) >= Fraction(8, 10):
                    label[i] = label[j] = min(label[i], label[j])
    k = Tokenizer.from_file(WORD_BPE)
    return {i: [*k.encode(EMAIL.sub("<EMAIL>", t), add_special_tokens=False).ids, 2] for i, t in kept if label[i] == i}


def test_pipeline(spark):
    r = random.Random(9)
    words = ["river", "stone", "green", "walk", "moon", "rain", "story", "table", "candle", "paper", "cloud", "window", "garden"]
    texts = [None, "", "12 34 !"]
    for i in range(60):
        w = [r.choice(words) for _ in range(40)]
        texts.append(" ".join(w + ["moron"] * (i % 4 == 0) + [f"x{i}@mail.example.com"] * (i % 5 == 0)))
        if i % 6 == 1:
            texts.append(texts[-1] + " again")
    folder = shared_path(spark, "pipeline-tables")
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int("moron" in (t or ""))) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = {}
    for p in sorted(corpus_pipeline.run(spark, folder).collect(), key=lambda p: (p["doc_id"], p["start"])):
        got.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["ids_crc32"]))
    want = expected(texts, "moron")
    assert got == {i: [(0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] for i, ids in want.items()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_duplicates", "pii", "packing"]
    first = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert first.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage_judges_by_distance(spark):
    r = random.Random(4)
    clean = lambda: " ".join("".join(r.choice("lmnrst") + r.choice("aeiou") + r.choice(["", "", "n", "s"]) for _ in range(r.randint(1, 4))) for _ in range(60))
    junk = [r.randbytes(300).hex(), base64.b64encode(r.randbytes(300)).decode(), "zq xk jj wq vvx qqz " * 9]
    texts = [*(clean() for _ in range(40)), *junk, "12 34 !", None]
    docs = lambda lang: spark.createDataFrame([(i, t, lang if i < 39 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    left = lambda d: sorted(x["doc_id"] for x in corpus_pipeline.drop_no_language(spark, d, "").collect())
    assert left(docs("en")) == list(range(40))  # document 39 is clean without a label
    assert left(docs(None)) == list(range(43))
    assert left(docs("en").withColumn("text", F.when(F.col("doc_id") < 39, "ab").otherwise(F.col("text")))) == list(range(43))  # too little to learn from
