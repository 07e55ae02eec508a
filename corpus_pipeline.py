"""From raw documents to packed training sequences.

Each stage works on all that its predecessor kept and is written as Parquet
before the next one reads it.  All of them take null and empty texts (a null one
counts as empty), very long texts whole, rows that repeat, null ids, an empty table (the result is
empty, too) and further columns; all but the last return the columns of their input, whatever
their names, as long as these don't begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldstream.llm import exact_dedup, packing, pii, quality_rules, simhash
from fieldstream.llm.shared import keep, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and the bands of tokeniser fertility accept; empty texts go, having too few words, and equal rows stay or go together."""
    return quality_rules.keep_good(docs)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id, one of rows that repeat; null ids lose to all others, and null and empty texts are equal."""
    return exact_dedup.drop_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group alike in five-word shingles by 0.8 or more, the one with the smallest doc_id; rows without an id stay."""
    return simhash.drop_near(docs, words=5, similarity=0.8)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each span of personal data replaced by its kind, n_chars with them; a null text stays null."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences; an empty text is the end mark alone, and rows that repeat each have their pieces."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", good_quality),
    ("exact_dedup", no_copies),
    ("simhash_near_dedup", no_near_copies),
    ("pii", no_personal_data),
    ("packing", packed),
]

#: SQL can't express fingerprint components, the trained classifier or the cuts; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = keep(docs, name)
    return docs
