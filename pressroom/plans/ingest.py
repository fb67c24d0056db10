"""One batch of raw feed, from records to stored articles."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..config import Settings
from ..functions.dates import moment, parse_date
from ..functions.text import enriched_text
from ..config import FETCH_METHODS
from ..errors import FeedError
from ..operators.crawl import close_runs, open_runs, stopped_runs, topic_summary, with_header
from ..operators.dedup import COMPONENT_ROWS, FLOOR_ROWS, check_order, first_accepts, heavy_pair, sightings, touched, with_keys
from ..operators.numbering import number_rows
from ..runtime import Scratch
from ..sources.corpus import Corpus
from ..sources.feed import arrival_order, normalise_feed

Embed = Callable[[DataFrame], DataFrame]
FEW_NUMBERS = 200_000  # accepted records that are broadcast to their texts: some 40 MB


@dataclass(frozen=True)
class Ingested:
    """What a batch adds to the corpus, plus its accounting."""

    articles: DataFrame
    sightings: DataFrame
    summary: DataFrame
    decisions: DataFrame


def ingest_batch(
    raw: DataFrame,
    scratch: Scratch,
    as_of: str,
    settings: Settings = Settings(),
    known_keys: DataFrame | None = None,
    known_urls: DataFrame | None = None,
    start_id: int = 1,
    by: tuple[str, ...] = ("topic",),
    component_rows: int = COMPONENT_ROWS,
    floor_rows: int = FLOOR_ROWS,
    header: DataFrame | None = None,
    topics: Sequence[str] = (),
) -> Ingested:
    """Deduplicate a feed against itself and what is known.

    Hashing happens once; all rounds then work on a narrow table of hashes.
    Whole texts are read again only for the accepted records, which meet their
    numbers by broadcast as long as these are few. Runs that the header calls
    rate-limited or failed store nothing. Records without ``ord`` are numbered as
    they arrive (``topics``: the order of the topics); a null or repeated ``ord``
    or an unknown fetch method raises FeedError before anything is stored.
    """
    feed = normalise_feed(arrival_order(raw, scratch, topics), settings)
    if header is not None:
        run = ["batch", "topic", "method"]
        feed = feed.join(stopped_runs(header, run), run, "left_anti")
    keyed = with_keys(feed, settings.empty_slug)
    narrow = scratch.cut(
        keyed.select(
            "ord", "batch", "topic", "method", "is_valid", "title_slug", "publisher_norm",
            *_as_bytes("composite_key", "url_hash"), moment(as_of).alias("seen_at"),
        ),
        "keyed",
    )
    check_order(narrow)
    _check_methods(narrow)
    valid = narrow.where("is_valid")
    known_keys = None if known_keys is None else touched(known_keys.select(*_as_bytes("composite_key")), valid, "composite_key", scratch)
    known_urls = None if known_urls is None else touched(known_urls.select(*_as_bytes("url_hash")), valid, "url_hash", scratch)
    heavy, heavy_urls = heavy_pair(valid, scratch, floor_rows)
    won = first_accepts(
        valid, scratch, known_keys, known_urls,
        component_rows=component_rows, floor_rows=floor_rows, heavy_keys=heavy, heavy_urls=heavy_urls,
    )
    accepted = scratch.cut(number_rows(won, ["ord"], scratch, start_id), "accepted")
    numbers = _as_hex(accepted, "composite_key", "url_hash")
    few = accepted.count() <= FEW_NUMBERS
    stored = feed.join(F.broadcast(numbers) if few else numbers, "ord").withColumn("published_at", parse_date(F.col("published_date")))
    return Ingested(
        articles=stored.withColumn("ingested_at", moment(as_of)),
        sightings=_as_hex(sightings(valid, accepted, known_keys, heavy), "composite_key"),
        summary=topic_summary(narrow, accepted, list(by)),
        decisions=_as_hex(
            narrow.join(accepted.select("ord", "id"), "ord", "left"), "composite_key", "url_hash"
        ),
    )


def _check_methods(narrow: DataFrame) -> None:
    """Raise when a record names an unknown fetch method; reads one column of a written table."""
    known = F.coalesce(F.col("method").isin(*FETCH_METHODS), F.lit(False))
    bad = narrow.agg(F.min(F.when(~known, F.coalesce("method", F.lit("null")))).alias("method")).first()["method"]
    if bad is not None:
        raise FeedError(f"unknown fetch method: {bad!r}")


def _as_bytes(*columns: str) -> list[Column]:
    """Hex digests as 32 bytes: half of what every shuffle has to carry."""
    return [F.unhex(c).alias(c) for c in columns]


def _as_hex(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.lower(F.hex(c)) for c in columns})


def vector_rows(articles: DataFrame, embed: Embed, dim: int) -> DataFrame:
    """Vector table rows of articles; ``embed`` adds ``embedding`` for ``document``."""
    document = enriched_text(
        *(F.col(c) for c in (
            "topic", "publisher_name", "published_date", "country", "title", "summary", "full_text"))
    )
    ready = articles.select(
        "id", "embed_model", F.lit(dim).alias("embed_dim"), "topic", "country", "language",
        F.col("publisher_name").alias("publisher"), "published_date", "title", "url",
        document.alias("document"),
    )
    made = embed(ready)
    length = F.coalesce(F.size("embedding"), F.lit(0))
    wrong = F.raise_error(F.concat(F.lit("EmbeddingMismatch: a vector has "), length.cast("string"), F.lit(f" dimensions, not {dim}")))
    return made.withColumn("embedding", F.when(length == dim, F.col("embedding")).otherwise(wrong.cast(made.schema["embedding"].dataType)))


def ingest_into(
    corpus: Corpus,
    batch: str,
    raw: DataFrame,
    as_of: str,
    embed: Embed,
    settings: Settings = Settings(),
    header: DataFrame | None = None,
    topics: Sequence[str] = (),
) -> DataFrame | None:
    """Ingest a batch and commit it; its summary, or None if already committed.

    Every run is logged as ``partial`` before the work and stays so if the work
    fails; when the batch is committed it is logged again with its counts and the
    seconds it took. ``header`` (batch, topic, method, rate_limited, error,
    started_at, duration_seconds) announces runs; without one they are those of
    the feed. Articles are embedded before anything becomes visible, so a failing
    model leaves no article without a vector. The corpus refuses another model
    or dimension than its own.
    """
    corpus.check_model(settings.embed_model, settings.embed_dim)
    if corpus.is_committed(batch):
        return None
    begun = time.monotonic()
    with Scratch(corpus.spark, "ingest") as scratch:
        run = ["batch", "topic", "method"]
        if header is None:
            header = raw.select(*run).distinct().withColumns({
                "rate_limited": F.lit(False), "error": F.lit(None).cast("string"),
                "started_at": moment(as_of), "duration_seconds": F.lit(None).cast("double"),
            })
        run_id = F.concat_ws("/", F.lit(batch), *run).alias("run_id")
        header = scratch.cut(header.select(run_id, *run, "rate_limited", "error", F.coalesce("started_at", moment(as_of)).alias("started_at"), "duration_seconds"), "header")
        corpus.log_runs(open_runs(header))
        known = corpus.read("articles")
        got = ingest_batch(
            raw, scratch, as_of, settings,
            known_keys=known.select("composite_key"), known_urls=known.select("url_hash"),
            start_id=corpus.next_id(), by=tuple(run), header=header, topics=topics,
        )
        counted = scratch.cut(
            with_header(got.summary, header, run).withColumns({
                "run_id": F.coalesce("run_id", run_id), "started_at": F.coalesce("started_at", moment(as_of))}),
            "summary",
        )
        corpus.publish(batch, {
            "articles": got.articles,
            "vectors": lambda written: vector_rows(written["articles"], embed, settings.embed_dim),
            "sightings": got.sightings,
        })
        took = F.coalesce("duration_seconds", F.lit(round(time.monotonic() - begun, 3)))
        counted = counted.withColumn("duration_seconds", took)
        corpus.log_runs(close_runs(counted))
    return corpus.runs(batch).withColumnsRenamed({"new_articles": "new", "skipped_dupes": "skipped"})
