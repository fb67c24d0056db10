"""A news feed derived from the general test tables.

Documents become feed records dated by events: all events are dealt out to the
documents in equal runs, of which the last time and the first type count. All
pages are dealt out likewise, in runs of which the least URL counts, to evenly
spaced documents; the others have URLs of their own. Every document is used with
its whole text; the joins are on equality, so the feed grows with the tables.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..runtime import spread

AS_OF = "2024-01-31 00:00:00"
# Vectors exist for the first articles only; searches are asked at their time.
SEARCH_AS_OF = "2024-01-08 00:00:00"
MODEL = "hash-embed"
DIM = 64

# Which fetch method stands for which event type.
METHOD_OF_TOPIC = {
    "click": "get_news",
    "view": "get_top_news",
    "purchase": "get_news_by_topic",
    "signup": "get_news_by_location",
    "error": "get_news_by_site",
}


class Deal(NamedTuple):
    """How events and pages are dealt out: lengths and numbers of runs; every ``step``-th document gets pages."""

    events: int
    event_slots: int
    step: int
    pages: int
    page_slots: int


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _country() -> Column:
    return F.expr("case lang when 'en' then 'US' when 'fr' then 'FR' when 'de' then 'DE' else 'ES' end")


def _method() -> Column:
    choice = F.lit("get_news")
    for topic, method in METHOD_OF_TOPIC.items():
        choice = F.when(F.col("event_type") == topic, F.lit(method)).otherwise(choice)
    return choice


def feed_from(documents: DataFrame, events: DataFrame, pages: DataFrame, deal: Deal) -> DataFrame:
    """Raw feed of ``documents``: each gets a run of events, each ``deal.step``-th a run of pages."""
    runs = events.groupBy(F.expr(f"event_id div {deal.events}").alias("slot")).agg(
        F.max("ts").alias("ts"), F.min_by("event_type", "event_id").alias("event_type"))
    urls = pages.groupBy(F.expr(f"page_id div {deal.pages}").alias("page_slot")).agg(F.min("url").alias("page_url"))
    dated = documents.withColumns({
        "slot": F.col("doc_id") % F.lit(deal.event_slots),
        "page_slot": F.expr(f"doc_id div {deal.step}") % F.lit(deal.page_slots),
    }).join(runs, "slot").join(urls, "page_slot", "left")
    own_url = F.concat(
        F.lit("https://news.example.com/a/"), F.col("doc_id").cast("string"), F.lit("?utm_source=rss")
    )
    return dated.select(
        F.date_format("ts", "yyyy-MM-dd").alias("batch"),
        _method().alias("method"),
        F.col("event_type").alias("topic"),
        F.col("doc_id").alias("ord"),
        F.btrim(F.regexp_extract("text", r"^[^.\n!?]*", 0)).alias("title"),
        F.when(F.col("doc_id") % deal.step == 0, F.col("page_url")).otherwise(own_url).alias("url"),
        F.col("text").alias("description"),
        F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("published date"),
        F.lit(None).cast("string").alias("published_date"),
        F.when(
            F.col("doc_id") % 4 == 0,
            F.struct(
                F.when(F.col("doc_id") % 8 == 0, F.col("source")).otherwise(F.lit("")).alias("title"),
                F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com")).alias("href"),
            ),
        ).alias("publisher"),
        F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("publisher_text"),
        _country().alias("country"),
        F.col("lang").alias("language"),
        F.lit(None).cast("string").alias("full_text"),
    )


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, events, pages = (table(spark, sf_dir, n) for n in ("documents", "events", "pages"))
    return feed_from(spread(documents), events, pages, deal_of(events, documents, pages))


def deal_of(events: DataFrame, documents: DataFrame, pages: DataFrame) -> Deal:
    """Lengths of runs so that no event and no page is left over; row counts come from file footers."""
    n_events, n_documents, n_pages = events.count(), max(1, documents.count()), pages.count()
    run = max(1, -(-n_events // n_documents))
    step = max(1, n_documents // max(1, n_pages))
    pages_run = max(1, -(-n_pages // (n_documents // step)))
    return Deal(run, max(1, -(-n_events // run)), step, pages_run, max(1, -(-n_pages // pages_run)))
