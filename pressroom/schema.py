"""Explicit schemas of every table, as DDL text; nothing is inferred at read time."""

from __future__ import annotations

RAW_FEED = (
    "batch STRING, method STRING, topic STRING, ord BIGINT, title STRING, url STRING, "
    "description STRING, `published date` STRING, published_date STRING, "
    "publisher STRUCT<title: STRING, href: STRING>, publisher_text STRING, "
    "country STRING, language STRING, full_text STRING"
)

ARTICLES = (
    "id BIGINT, title STRING, url STRING, url_hash STRING, publisher_name STRING, "
    "publisher_href STRING, published_date STRING, published_at TIMESTAMP_NTZ, summary STRING, "
    "full_text STRING, country STRING, language STRING, topic STRING, embed_model STRING, "
    "embed_dim INT, ingested_at TIMESTAMP_NTZ, composite_key STRING"
)

VECTORS = (
    "id BIGINT, embedding ARRAY<FLOAT>, embed_model STRING, embed_dim INT, topic STRING, "
    "country STRING, language STRING, publisher STRING, published_date STRING, title STRING, "
    "url STRING, document STRING"
)

SIGHTINGS = (
    "composite_key STRING, title_slug STRING, publisher_norm STRING, article_id BIGINT, "
    "seen BIGINT, first_seen TIMESTAMP_NTZ, last_seen TIMESTAMP_NTZ"
)

CRAWL_RUNS = (
    "run_id STRING, topic STRING, method STRING, fetched BIGINT, new_articles BIGINT, "
    "skipped_dupes BIGINT, status STRING, error_message STRING, started_at TIMESTAMP_NTZ, "
    "duration_seconds DOUBLE"
)

MODEL = "embed_model STRING, embed_dim INT"

# A change of stored vectors: rows put in or (with only an id) taken out.
CHANGES = f"{VECTORS}, deleted BOOLEAN, change BIGINT"

# Changes worked into the stored vectors: the last one, batch folders that no longer count, those written in their place.
FOLDS = "through BIGINT, replaced ARRAY<STRING>, written ARRAY<STRING>"

# Articles per topic and day of one batch, and those taken out since.
DAILY = "topic STRING, day DATE, articles BIGINT"
REMOVALS = "id BIGINT, topic STRING, day DATE"

COMMITS = ("batch STRING, articles BIGINT, max_id BIGINT")
