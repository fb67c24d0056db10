"""Shared inputs of the contract queries, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Settings
from ..functions.dates import moment, parse_date
from ..sources.derived import AS_OF, DIM, MODEL, raw_feed, table
from ..sources.feed import normalise_feed

SETTINGS = Settings(embed_model=MODEL, embed_dim=DIM)


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_feed(raw_feed(spark, sf_dir), SETTINGS)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as stored articles, before any deduplication: id is ``ord``."""
    dated = feed(spark, sf_dir).withColumn("published_at", parse_date(F.col("published_date")))
    return dated.withColumns({"id": F.col("ord"), "ingested_at": moment(AS_OF)}).drop("ord")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors with the place columns of their article, if it exists."""
    place = feed(spark, sf_dir).select(F.col("ord").alias("id"), "country", "language", "topic")
    stored = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", "label", F.lit(MODEL).alias("embed_model")
    )
    return stored.join(place, "id", "left")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The stored vector with id 0 stands for an embedded query text."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feed topics, and as many in capitals that have no article."""
    names = table(spark, sf_dir, "events").select("event_type").distinct()
    return names.select(F.explode(F.array("event_type", F.upper("event_type"))).alias("topic"))
