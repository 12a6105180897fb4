"""Corpus pipeline: documents through language ID, n-gram Jaccard join, substring dedup, personal data and packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns the columns of documents; the last
returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import jaccard_join, langid, packing, pii, substrings
from vellum.llm.common import settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; a missing lang is filled in. Null texts, texts without letters and texts below the calibrated floor go."""
    found = langid.predict(docs, langid.train(docs)).where("not lang_rejected")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect: the one with the smallest doc_id. The ids that go are broadcast up to a checked number, so that
    texts need not move; beyond it the join is a shuffle."""
    gone = jaccard_join.near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    if gone.limit(jaccard_join.BROADCAST_IDS + 1).count() <= jaccard_join.BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 50-word passages that a document with a smaller doc_id holds; other texts stay as they are."""
    cut = substrings.dedup_substrings(docs, extra=("lang", "source"), same_if_whole=True)
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind in brackets."""
    masked = pii.mask(pii.find(docs, pii.train(docs)))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts' token ids, placed in sequences of at most 1024."""
    import public_tokenizers

    placed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("personal_data", personal_data), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
