"""Exact first-come deduplication over keys and URLs.

A record is accepted iff no earlier accepted record has its key or its URL.
Records are edges between a key and a URL, and the accepted ones are the
matching a sequential pass would find. In parallel: an edge that comes first
both for its key and for its URL is certain; take those, drop what they rule
out, repeat. Two window ranks do not do this: a record refused for its URL
must leave its key free.

A round takes one link off each end of a chain, so after some rounds the
remainder is cut into connected components, which do not touch each other.
Small components are walked in order, many at a time; only a component that
is too large for one task goes through further rounds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.stages import staged
from ..functions.text import key_of, publisher_norm, title_slug
from ..functions.urls import with_canonical_url
from ..errors import FeedError
from ..runtime import Scratch
from ..sources.feed import is_valid
from .components import components
from .skew import FLOOR_ROWS, heavy_values, join_unique, shuffled

ROUNDS = 3  # before the remainder is cut into components
# A component of at most so many rows (of some 100 bytes) is walked by one task.
COMPONENT_ROWS = 500_000


def with_keys(feed: DataFrame, empty_slug: str = "keep") -> DataFrame:
    """Add title_slug, publisher_norm, composite_key, url_hash and is_valid.

    A URL without canonical form makes the record invalid: it counts as
    fetched and nothing else.
    """
    hashed = with_canonical_url(feed, "url", "url_canonical", "url_hash")
    keyed = staged(
        hashed,
        "__key_",
        lambda v: {
            "slug": title_slug(F.col("title")),
            "publisher": publisher_norm(F.col("publisher_name")),
        },
        lambda v: {"key": key_of(v("slug"), v("publisher"), F.col("url_hash"), empty_slug)},
        keep={"slug": "title_slug", "publisher": "publisher_norm", "key": "composite_key"},
    )
    return keyed.withColumn("is_valid", is_valid() & F.col("url_hash").isNotNull())


def heavy_pair(
    rows: DataFrame, scratch: Scratch, floor_rows: int = FLOOR_ROWS
) -> tuple[DataFrame | None, DataFrame | None]:
    """Heavy keys and heavy URLs of the records."""
    total = rows.count()
    keys, urls = (heavy_values(rows, c, scratch, floor_rows, total) for c in ("composite_key", "url_hash"))
    return keys, urls


def first_accepts(
    rows: DataFrame,
    scratch: Scratch,
    known_keys: DataFrame | None = None,
    known_urls: DataFrame | None = None,
    component_rows: int = COMPONENT_ROWS,
    floor_rows: int = FLOOR_ROWS,
    heavy_keys: DataFrame | None = None,
    heavy_urls: DataFrame | None = None,
) -> DataFrame:
    """Accepted records as (ord, composite_key, url_hash).

    ``rows`` holds valid records with a unique, total ``ord`` (see
    ``check_order``); known keys and URLs are those of earlier batches, each at
    most once. Keys and hashes may be of any type, the same on both sides.
    """
    if heavy_keys is None and heavy_urls is None:
        heavy_keys, heavy_urls = heavy_pair(rows, scratch, floor_rows)
    # Copies with equal key and URL: all but the first are always refused.
    live = rows.groupBy("composite_key", "url_hash").agg(F.min("ord").alias("ord"))
    if known_keys is not None:
        live = join_unique(live, known_keys.select("composite_key"), "composite_key", heavy_keys, "left_anti")
    if known_urls is not None:
        live = join_unique(live, known_urls.select("url_hash"), "url_hash", heavy_urls, "left_anti")
    live = scratch.cut(live, "live")
    schema = live.schema

    won_path = scratch.path("won")
    reader = rows.sparkSession.read
    rounds, before = 0, -1
    while True:
        left = live.count()  # from the footers of the written table
        if left == 0 and rounds:
            break
        if left == before:
            raise FeedError("no record comes first for its key and its URL: ord is null or repeated")
        before = left
        if rounds and rounds % ROUNDS == 0:
            small, live = _components(live, scratch, component_rows, left)
            _walk(small).write.parquet(f"{won_path}/round={rounds}-small")
            if live is None:
                break
        # Smallest numbers only: they fit the hash aggregation, and what the
        # two sides have in common is found on one long per key and URL.
        by_key = live.groupBy("composite_key").agg(F.min("ord").alias("ord")).select("ord")
        by_url = live.groupBy("url_hash").agg(F.min("ord").alias("ord")).select("ord")
        both = by_key.join(shuffled(by_url, left), "ord")
        live.join(shuffled(both, left), "ord", "left_semi").write.parquet(f"{won_path}/round={rounds}")
        won = reader.schema(schema).parquet(f"{won_path}/round={rounds}")
        rest = join_unique(live, won.select("composite_key"), "composite_key", heavy_keys, "left_anti", left)
        rest = join_unique(rest, won.select("url_hash"), "url_hash", heavy_urls, "left_anti", left)
        live = scratch.cut(rest.select(*live.columns), "live")
        rounds += 1
    return reader.schema(schema).parquet(won_path).select("ord", "composite_key", "url_hash")


MOST_MARKS = 2_000_000  # records of a batch whose 8-byte marks are broadcast: some 50 MB


def touched(known: DataFrame, rows: DataFrame, column: str, scratch: Scratch, most: int = MOST_MARKS) -> DataFrame:
    """The ``known`` values of earlier batches that ``rows`` may hold, written.

    The marks of a batch go to the history, which is scanned where it lies and never shuffled; what
    comes back is as small as the batch. Values that share a mark with one of the batch come along and
    change nothing. A batch of more than ``most`` records, such as an initial load, meets the whole history.
    """
    known = known.select(column)
    if rows.count() > most:
        return known
    marks = rows.select(F.xxhash64(column).alias("__mark")).distinct()
    return scratch.cut(known.withColumn("__mark", F.xxhash64(column)).join(F.broadcast(marks), "__mark", "left_semi").select(column), f"known-{column}")


def check_order(rows: DataFrame) -> None:
    """Raise unless every row has an ``ord`` of its own; ``rows`` is a written, narrow table."""
    found = rows.agg(F.count("*").alias("rows"), F.count("ord").alias("numbered"), F.count_distinct("ord").alias("numbers")).first()
    if found["numbered"] < found["rows"]:
        raise FeedError(f"{found['rows'] - found['numbered']} records have no ord")
    if found["numbers"] < found["rows"]:
        raise FeedError(f"{found['rows'] - found['numbers']} records repeat the ord of another")


def _components(live: DataFrame, scratch: Scratch, most: int, total: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of components with at most ``most`` of the ``total`` rows, with their component, and the other rows (None if none).

    Keys and URLs are nodes numbered by hash; two nodes with one number would
    only be walked together, which changes nothing.
    """
    nodes = live.withColumn("a", F.xxhash64(F.lit("key"), "composite_key"))
    links = nodes.select("a", F.xxhash64(F.lit("url"), "url_hash").alias("b"))
    label = components(links, scratch)
    placed = scratch.cut(nodes.join(shuffled(label, total), nodes["a"] == label["node"]).select(*live.columns, "component"), "placed")
    sizes = placed.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most)
    large = scratch.cut(sizes.select("component"), "large")
    if large.isEmpty():
        return placed, None
    rest = scratch.cut(placed.join(large, "component", "left_semi").select(*live.columns), "live")
    return placed.join(large, "component", "left_anti"), rest


def _walk(rows: DataFrame) -> DataFrame:
    """The sequential pass over each component."""
    schema = rows.drop("component").schema

    def walk(batches):
        keys, urls, at = set(), set(), None
        for pdf in batches:
            kept = []
            for component, key, url, place in zip(pdf["component"], pdf["composite_key"], pdf["url_hash"], pdf["ord"]):
                if component != at:
                    keys, urls, at = set(), set(), component
                if key not in keys and url not in urls:
                    keys.add(key)
                    urls.add(url)
                    kept.append((key, url, place))
            yield pd.DataFrame(kept, columns=["composite_key", "url_hash", "ord"])

    ordered = rows.repartition("component").sortWithinPartitions("component", "ord")
    return ordered.select("component", "composite_key", "url_hash", "ord").mapInPandas(walk, schema)


def known_repeats(rows: DataFrame, known_keys: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """Records whose key an earlier batch has accepted."""
    return join_unique(rows, known_keys.select("composite_key"), "composite_key", heavy, "left_semi")


def sightings(
    rows: DataFrame,
    accepted: DataFrame,
    known_keys: DataFrame | None = None,
    heavy_keys: DataFrame | None = None,
) -> DataFrame:
    """This batch's additions to the sighting ledger, one row per key.

    The accepted record of a key counts, and so does every later record with
    that key; a record refused for its URL counts only if its key was known by
    then. ``rows`` carries ``seen_at``; ``accepted`` carries ``id``.
    """
    facts = rows.select("composite_key", "title_slug", "publisher_norm", "ord", "seen_at")
    firsts = accepted.select("composite_key", F.col("ord").alias("first_ord"), F.col("id").alias("article_id"))
    seen = join_unique(facts, firsts, "composite_key", heavy_keys, "inner").where("ord >= first_ord")
    if known_keys is not None:
        again = known_repeats(facts, known_keys, heavy_keys)
        seen = seen.unionByName(again.withColumn("article_id", F.lit(None).cast("bigint")), allowMissingColumns=True)
    return seen.groupBy("composite_key", "title_slug", "publisher_norm").agg(
        F.max("article_id").alias("article_id"),
        F.count("*").alias("seen"),
        F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"),
    )


def seen_ledger(log: DataFrame, articles: DataFrame | None = None) -> DataFrame:
    """The dedup index: all batches' sightings of a key added up.

    With ``articles`` given, the id of an article that is gone reads as null.
    """
    ledger = log.groupBy("composite_key").agg(
        F.min("title_slug").alias("title_slug"),
        F.min("publisher_norm").alias("publisher_norm"),
        F.max("article_id").alias("article_id"),
        F.sum("seen").alias("seen_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    if articles is None:
        return ledger
    kept = articles.select(F.col("id").alias("article_id"), F.lit(True).alias("__kept"))
    return (
        ledger.join(kept, "article_id", "left")
        .withColumn("article_id", F.when(F.col("__kept"), F.col("article_id")))
        .select(*ledger.columns)
    )


def is_duplicate(rows: DataFrame, ledger: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """Add ``is_known``: whether the ledger holds the record's key.

    ``heavy``: keys that many of ``rows`` share, from ``heavy_values``.
    """
    known = ledger.select("composite_key").distinct().withColumn("is_known", F.lit(True))
    return join_unique(rows, known, "composite_key", heavy, "left").withColumn(
        "is_known", F.coalesce("is_known", F.lit(False))
    )
