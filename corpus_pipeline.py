"""A training-corpus pipeline of five stages over `documents`; each stage's result is the next one's input."""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofframe.llm import langid, packing, pii, sigtree, toxicity
from proofframe.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine trained on `labels` calls toxic go. Null texts stay; repeated rows stay or go together;
    without labels of both kinds, and of an empty table, nothing goes."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    found = toxicity.decisions(docs, model, *docs.columns)
    return found.where(toxicity.toxic(model) < 0.5).select(docs.columns)


def drop_no_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go: null, without a letter, or far from every profile. The distance decides only where
    some language has a full profile; else all texts with letters stay. Repeated rows stay or go together; an empty table
    gives no rows."""
    profiles = langid.train(docs)
    learned = any(len(p) == langid.PROFILE for p in profiles.values())
    found = langid.identify(docs, profiles, *docs.columns)
    return found.where(F.col(langid.named("distance", docs.columns)) <= (langid.FAR if learned else 1.0)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity 0.8 or more. Of rows that repeat a doc_id one
    stays; null doc_ids and texts without words all stay; an empty table gives no rows."""
    return sigtree.JaccardJoin(width=5, threshold=Fraction(8, 10)).deduplicated(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts give way to their kinds; n_chars follows. Null texts stay null, repeated rows stay, an empty
    table gives no rows."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens. Null and empty texts are one id, the end;
    repeated rows are pieces of their own; an empty table gives no rows."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_no_language),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact),
    ("packing", pack),
]

#: The stages hold trained models, a join over sets and a packing, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
