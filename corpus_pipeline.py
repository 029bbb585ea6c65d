"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is written as Parquet
and read again as the next one's docs. All stages but the last return the columns of documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from thawline.llm import langid, packing, pii, setjoin
from thawline.llm.common import bounded_batches, documents, stored, text_of

LEAST_LANGUAGE_SHARE = 0.5
SHINGLE_WORDS = 5
PERCENT = 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose main language has at least half of the text; the others go, null texts among them."""
    bounded_batches(spark)
    return langid.in_known_language(docs, langid.train_on_open(docs), LEAST_LANGUAGE_SHARE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    A row without an id is known by its text; rows that share an id and a text are one document. Of several texts with
    the smallest id the one with the smallest hash stays.
    """
    bounded_batches(spark)
    own = F.coalesce(F.col("doc_id"), -1 - F.shiftrightunsigned(F.xxhash64(text_of()), 2))
    keyed = docs.withColumns({"_own": own, "_key": F.xxhash64(own, text_of())})
    groups = setjoin.join(keyed.select(F.col("_key").alias("doc_id"), text_of().alias("text")), SHINGLE_WORDS, PERCENT)
    placed = groups.select(F.col("doc_id").alias("_key"), "component_id").join(keyed.select("_key", "_own"), "_key")
    kept = placed.groupBy("component_id").agg(F.min(F.struct("_own", "_key")).alias("_first")).select("_first._key")
    return keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).drop("_key", "_own")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind; a null text stays null, no rows give no rows."""
    bounded_batches(spark)
    return pii.redacted(docs, pii.learn(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; a null text is empty and has the end id alone, no rows give no rows."""
    bounded_batches(spark)
    return packing.op5_harmonic_packing(docs)


STAGES = [("language", known_language), ("near duplicates", one_of_each_group),
          ("personal data", without_personal_data), ("packing", packed)]

# Mixtures, boosted trees and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
