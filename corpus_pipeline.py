"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last keep the columns of ``documents``.
Rows that a stage rejects are gone for the stages after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressroom.llm import chosen_path, hyperdim, length_buckets, quotient, templates
from pressroom.llm.common import read
from pressroom.runtime import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in some language stay; those without a letter (and null ones) go. Profiles are learnt from all rows with a language."""
    return hyperdim.with_language(docs, F.col("lang").isNotNull())


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return quotient.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    return chosen_path.near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other numbers, names and units, go."""
    return templates.decontaminate(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of every document left."""
    return length_buckets.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

# Language identification and the near-duplicate join have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
