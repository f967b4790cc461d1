"""The corpus pipeline: stages over `documents`, each written as Parquet and read again.

Every stage works on all rows the one before it kept; all but the last return the columns of
`documents`. Language profiles are learned from the stage's own input."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoweft.llm import decontaminate, exact_dedup, language, near_dedup, queries
from geoweft.operators.grid import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which no language is found (those without a letter)."""
    return language.identified_only(docs, language.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.deduplicated(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontaminate.decontaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return queries.encoded_and_decoded(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean), ("bpe", tokens)]
# Rank profiles, near-duplicate classes and tilings are beyond SQL; tests hold run() against
# a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
