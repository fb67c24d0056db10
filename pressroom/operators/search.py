"""Semantic search with recency, keyword fallback and presets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import RECENCY_WEIGHT, WINDOW_FACTOR
from ..functions.dates import blend, recency_score, since_day
from ..runtime import Scratch
from .keyword import Index, keyword_search
from .skew import heavy_values, join_unique
from .vectors import check_length, nearest, nearest_batch

MOST_IDS = 10_000  # ids that a scan filter may name

RESULT = (
    "id", "title", "url", "publisher", "published_date", "summary", "country", "language", "topic",
)


def project(articles: DataFrame, *extra: str | Column) -> DataFrame:
    """Result columns of a search row, then ``extra``."""
    named = F.col("publisher_name").alias("publisher")
    return articles.select(*[named if c == "publisher" else F.col(c) for c in RESULT], *extra)


def hydrate(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """Articles of the given ids; ids without article are simply absent."""
    return articles.join(ids.select("id").distinct(), "id", "left_semi")


def pick(articles: DataFrame, hits: DataFrame, most: int) -> DataFrame:
    """Articles of at most ``most`` hits, with the hits' columns.

    A result page names its ids in the scan's filter, so only row groups that can
    hold them are read; ids are consecutive in arrival order. A larger request joins.
    """
    if most > MOST_IDS:
        return articles.join(hits, "id")
    rows = hits.collect()
    found = articles.sparkSession.createDataFrame(rows, hits.schema)
    return articles.where(F.col("id").isin([r["id"] for r in rows])).join(F.broadcast(found), "id")


def _in_window(since: str | None) -> Column:
    """Date cut; undated articles fall out when there is one."""
    if since is None:
        return F.lit(True)
    return F.coalesce(F.col("published_at") >= F.lit(since).cast("timestamp_ntz"), F.lit(False))


def _score(as_of: str, compat: str, recency_weight: float) -> Column:
    recency = recency_score(F.col("published_at"), as_of, compat=compat)
    return blend(F.col("similarity"), recency, recency_weight)


def semantic_search(
    vectors: DataFrame,
    articles: DataFrame,
    query: Sequence[float],
    as_of: str,
    days: int | None = None,
    country: str | None = None,
    language: str | None = None,
    limit: int = 10,
    metric: str = "cosine",
    compat: str = "documented",
    date_filter: str = "post",
    recency_weight: float = RECENCY_WEIGHT,
    dim: int | None = None,
) -> DataFrame:
    """Neighbours re-ranked by similarity and recency.

    Three times ``limit`` neighbours are taken first and the date cut follows
    (``date_filter="post"``), so old neighbours can crowd out newer ones;
    ``"pre"`` cuts before the neighbours are chosen. ``dim`` is the corpus'
    dimension: a query of another length is refused before any job.
    """
    check_length(query, dim)
    since = since_day(as_of, days)
    if date_filter == "pre" and since is not None:
        vectors = vectors.join(articles.where(_in_window(since)).select("id"), "id", "left_semi")
    hits = nearest(vectors, query, limit * WINDOW_FACTOR, country, language, metric)
    found = pick(articles, hits, limit * WINDOW_FACTOR).where(_in_window(since))
    scored = found.withColumn("score", _score(as_of, compat, recency_weight))
    top = scored.orderBy(F.desc("score"), F.desc("similarity"), "id").limit(limit)
    return project(top, "score", F.lit("semantic").alias("search_mode"))


def search(
    text: str,
    vectors: DataFrame,
    articles: DataFrame,
    index: Callable[[], Index],
    embed_query: Callable[[str], Sequence[float]],
    as_of: str,
    days: int | None = None,
    country: str | None = None,
    language: str | None = None,
    semantic: bool = True,
    limit: int = 10,
    **options,
) -> DataFrame:
    """Semantic search, or keyword search if asked for or without any vector.

    Keyword rows keep the fixed score 0.0 and are ordered by their rank.
    ``index`` is only called when the keyword path is taken.
    """
    if semantic and not vectors.isEmpty():
        return semantic_search(
            vectors, articles, embed_query(text), as_of, days, country, language, limit, **options
        )
    found = keyword_search(index(), articles, text, limit, country, language, since_day(as_of, days))
    mode = F.lit("keyword").alias("search_mode")
    return project(found, F.lit(0.0).alias("score"), mode, "rank").orderBy("rank", "id")


def search_news(text: str, *args, **kwargs) -> DataFrame:
    """Preset: last 7 days, US, English, ten results."""
    defaults = {"days": 7, "country": "US", "language": "en", "limit": 10}
    return search(text, *args, **{**defaults, **kwargs})


def latest_for_topic(
    topic: str, index: Index, articles: DataFrame, limit: int = 10, order: str = "rank"
) -> DataFrame:
    """Preset: keyword search for a topic; by rank as documented, or by date."""
    found = keyword_search(index, articles, topic, limit, order=order)
    sort = [F.desc_nulls_last("published_at")] if order == "date" else []
    extra = (F.lit(0.0).alias("score"), F.lit("keyword").alias("search_mode"), F.col("rank"))
    ordered = found.orderBy(*sort, "rank", "id")
    return project(ordered, *extra)


def search_batch(
    queries: DataFrame,
    vectors: DataFrame,
    articles: DataFrame,
    as_of: str,
    scratch: Scratch,
    days: int | None = None,
    limit: int = 10,
    metric: str = "cosine",
    compat: str = "documented",
    recency_weight: float = RECENCY_WEIGHT,
    dim: int | None = None,
) -> DataFrame:
    """Semantic search for a table of (query_id, embedding), ``place`` from 1.

    One article may be a neighbour of most queries: such ids are found by a
    count and meet their article by broadcast.
    """
    hits = scratch.cut(nearest_batch(vectors, queries, limit * WINDOW_FACTOR, scratch, metric, dim=dim).drop("place"), "hits")
    needed = articles.select(*[c for c in (*RESULT, "publisher_name", "published_at") if c in articles.columns])
    found = join_unique(hits, needed, "id", heavy_values(hits, "id", scratch), "inner").where(_in_window(since_day(as_of, days)))
    scored = found.withColumn("score", _score(as_of, compat, recency_weight))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("similarity"), "id")
    ranked = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return project(ranked, "query_id", "place", "score", "published_at", F.lit("semantic").alias("search_mode"))
