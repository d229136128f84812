"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import uuid
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, centroids, html_text, langid, mpegts, oracle, packing, pii, resample, sigtree, token_store, toxicity, url_filter
from .common import shared_folder, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(rows, rows.where("vec_id % 100 = 0"), k=10)


def op2_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE, end_id=2)


def op3_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    model = toxicity.train(docs.where(~held_out), labels.where(~held_out).select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-store-{uuid.uuid4().hex}"
    token_store.write_store(table(spark, sf_dir, "documents"), path, WORD_BPE, end_id=1)
    return token_store.read_store(spark.read.parquet(path))


def op5_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.media_digests(table(spark, sf_dir, "documents"))


def op6_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.JaccardJoin(width=3, threshold=Fraction(9, 10)).groups(table(spark, sf_dir, "documents"))


def op7_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op8_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    found = langid.identify(docs, langid.train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_bloom_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, RULES))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op11_bisector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, scale=256, seed=2)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20, width=2, buckets=10_000, seed=7)


def op13_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_projected_neighbours, op2_nnls_packing, op3_string_kernel_toxicity, op4_token_store, op5_transport_stream,
        op6_signature_tree_join, op7_weak_supervision_pii, op8_rank_order_langid, op9_bloom_url_filter, op10_byte_bpe,
        op11_bisector_clusters, op12_importance_resampling, op13_block_rules,
    )
}
ORACLES: dict[str, str] = {"op6_signature_tree_join": oracle.JACCARD, "op9_bloom_url_filter": oracle.URLS, "op11_bisector_clusters": oracle.CLUSTERS, "op12_importance_resampling": oracle.RESAMPLE}
