"""Plain settings shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults that results depend on.
EMBED_MODEL = "all-MiniLM-L6-v2"
EMBED_DIM = 384
LANGUAGE = "en"
COUNTRY = "US"
RECENCY_WEIGHT = 0.3
DECAY_DAYS = 3.0
WINDOW_FACTOR = 3
FETCH_METHODS = (
    "get_news",
    "get_top_news",
    "get_news_by_topic",
    "get_news_by_location",
    "get_news_by_site",
)
RUN_STATUSES = ("success", "failed", "partial", "rate_limited")


@dataclass(frozen=True)
class Settings:
    """What an ingest stamps on the rows it accepts."""

    embed_model: str = EMBED_MODEL
    embed_dim: int = EMBED_DIM
    language: str = LANGUAGE
    country: str = COUNTRY
    empty_slug: str = "keep"  # "keep" | "url": see functions.text.composite_key
