"""Briefs and sentiment from search, for many topics at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import brief as B
from ..operators.search import search_batch
from ..runtime import Scratch

EmbedQueries = Callable[[DataFrame], DataFrame]  # adds ``embedding`` for ``document``


def ranked_for_topics(
    topics: DataFrame, vectors: DataFrame, articles: DataFrame, embed: EmbedQueries, as_of: str, scratch: Scratch,
    days: int, max_articles: int,
) -> DataFrame:
    """The best ``max_articles`` recent articles for each topic, searched by the topic's text."""
    queries = embed(topics.select(topics["topic"].alias("query_id"), topics["topic"].alias("document"))).select("query_id", "embedding")
    hits = search_batch(queries, vectors, articles, as_of, scratch, days=days, limit=max_articles)
    return scratch.cut(B.found_for_topics(hits), "ranked")


def brief_topics(
    topics: DataFrame, vectors: DataFrame, articles: DataFrame, embed: EmbedQueries, scorer: B.Scorer | None, as_of: str, scratch: Scratch,
    days: int = B.BRIEF_DAYS, max_articles: int = B.BRIEF_ARTICLES, include_citations: bool = True,
) -> DataFrame:
    """A cited brief per topic: search, cut to ``days`` and ``max_articles``, prompt, scorer, parsed reply."""
    ranked = ranked_for_topics(topics, vectors, articles, embed, as_of, scratch, days, max_articles)
    return B.brief(topics, ranked, scorer, days, include_citations)


def sentiment_topics(
    topics: DataFrame, vectors: DataFrame, articles: DataFrame, embed: EmbedQueries, scorer: B.Scorer | None, as_of: str, scratch: Scratch,
    days: int = B.SENTIMENT_DAYS, max_articles: int = B.SENTIMENT_ARTICLES, timeline: bool = False,
) -> DataFrame:
    """A verdict per topic, or with ``timeline`` one record of the overall verdict and those of the days."""
    ranked = ranked_for_topics(topics, vectors, articles, embed, as_of, scratch, days, max_articles)
    return B.sentiment_record(topics, ranked, scorer) if timeline else B.sentiment(topics, ranked, scorer)


def brief_last_week(*args, **kwargs) -> DataFrame:
    """Preset: seven days, twenty articles."""
    return brief_topics(*args, **{"days": 7, "max_articles": 20, **kwargs})


def sentiment_last_fortnight(*args, **kwargs) -> DataFrame:
    """Preset: fourteen days, fifteen articles."""
    return sentiment_topics(*args, **{"days": 14, "max_articles": 15, **kwargs})


def sentiment_last_week(*args, **kwargs) -> DataFrame:
    """Preset: seven days, fifteen articles."""
    return sentiment_topics(*args, **{"days": 7, "max_articles": 15, **kwargs})
