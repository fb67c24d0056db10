"""Counts over time and corpus figures."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import iso_text, since_day


_DATE = re.compile(r"\d{4}-\d{1,2}-\d{1,2}")


def is_day(text: str | None) -> bool:
    return text is None or _DATE.fullmatch(text) is not None


def stamped() -> Column:
    """When an article counts: its publication, else its ingest."""
    return F.coalesce("published_at", "ingested_at")


def timeline(
    articles: DataFrame,
    topic: str | None = None,
    days: int | None = None,
    start: str | None = None,
    end: str | None = None,
    as_of: str | None = None,
    compat: str = "documented",
) -> DataFrame:
    """(date, count) per day with articles, in order; ``start`` beats ``days``.

    A date-only ``end`` includes that day. ``compat="observed"`` compares
    ``end`` as text, which leaves the whole end day out.
    """
    begin = start or (since_day(as_of, days) if days is not None else None)
    when = stamped()

    def each(test):
        """``test`` of the time that counts, written so that the scan can use it."""
        return test(F.col("published_at")) | (F.col("published_at").isNull() & test(F.col("ingested_at")))

    rows = articles
    if topic:
        rows = rows.where(F.col("topic") == topic)
    if begin:
        first = F.lit(begin).cast("timestamp_ntz")
        rows = rows.where(each(lambda at: at >= first))
    if end:
        if compat == "observed":
            rows = rows.where(iso_text(when) <= end)
        elif _DATE.fullmatch(end):
            after = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
            rows = rows.where(each(lambda at: at < after))
        else:
            last = F.lit(end).cast("timestamp_ntz")
            rows = rows.where(each(lambda at: at <= last))
    counted = rows.groupBy(when.cast("date").alias("day")).agg(F.count("*").alias("count")).where("day is not null")
    return counted.select(F.date_format("day", "yyyy-MM-dd").alias("date"), "count").orderBy("date")


def daily_parts(articles: DataFrame) -> DataFrame:
    """(topic, day, articles): what a batch adds to the timelines."""
    return articles.groupBy("topic", stamped().cast("date").alias("day")).agg(F.count("*").alias("articles")).where("day is not null")


def timeline_of_parts(daily: DataFrame, topic: str | None = None, days: int | None = None, start: str | None = None, end: str | None = None, as_of: str | None = None) -> DataFrame:
    """``timeline`` from stored daily counts; ``start`` and ``end`` are whole days."""
    begin = start or (since_day(as_of, days) if days is not None else None)
    rows = daily if not topic else daily.where(F.col("topic") == topic)
    if begin:
        rows = rows.where(F.col("day") >= F.lit(begin).cast("date"))
    if end:
        rows = rows.where(F.col("day") <= F.lit(end).cast("date"))
    counted = rows.groupBy("day").agg(F.sum("articles").alias("count")).where("count > 0")
    return counted.select(F.date_format("day", "yyyy-MM-dd").alias("date"), "count").orderBy("date")


def timeline_last_month(articles: DataFrame, as_of: str, topic: str | None = None) -> DataFrame:
    """Preset of 30 days."""
    return timeline(articles, topic, days=30, as_of=as_of)


def timeline_last_week(articles: DataFrame, as_of: str, topic: str | None = None) -> DataFrame:
    """Preset of 7 days."""
    return timeline(articles, topic, days=7, as_of=as_of)


def timeline_all_topics(articles: DataFrame) -> DataFrame:
    """(topic, date, count) for every topic in one pass."""
    return topics_of_parts(daily_parts(articles))


def topics_of_parts(daily: DataFrame) -> DataFrame:
    """``timeline_all_topics`` from stored daily counts."""
    counted = daily.groupBy("topic", "day").agg(F.sum("articles").alias("count")).where("count > 0")
    return counted.select("topic", F.date_format("day", "yyyy-MM-dd").alias("date"), "count")


def corpus_stats(articles: DataFrame, vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """One row: articles, vectors, model and dimension."""
    counted = articles.select(F.lit(1).alias("a"), F.lit(0).alias("v")).unionAll(
        vectors.select(F.lit(0).alias("a"), F.lit(1).alias("v"))
    )
    return counted.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("total_articles"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("vector_count"),
    ).withColumns({"embed_model": F.lit(model), "embed_dim": F.lit(dim)})
