"""Crawl runs: accounting per batch and topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import RUN_STATUSES
from ..errors import FeedError


def topic_summary(rows: DataFrame, accepted: DataFrame, by: list[str]) -> DataFrame:
    """fetched / new / skipped per group; invalid records are only fetched.

    ``rows`` has one narrow row per record (ord, is_valid and the ``by``
    columns), ``accepted`` the accepted ``ord``s.
    """
    marked = rows.join(accepted.select("ord", F.lit(1).alias("__new")), "ord", "left")
    return marked.groupBy(*by).agg(
        F.count("*").alias("fetched"),
        F.count("__new").alias("new"),
        F.count(F.when(F.col("is_valid") & F.col("__new").isNull(), 1)).alias("skipped"),
    )


def with_header(summary: DataFrame, header: DataFrame, by: list[str]) -> DataFrame:
    """Counts of every run, announced in the header or only found in the feed.

    A rate limit or an error in the header sets the status; such runs store
    nothing (see ``stopped_runs``) and count nothing.
    """
    names = {c: f"__{c}" for c in by}
    counted = summary.withColumnsRenamed(names)
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    joined = header.join(counted, same, "full_outer").withColumns({c: F.coalesce(c, n) for c, n in names.items()}).drop(*names.values())
    limited, failed = F.coalesce("rate_limited", F.lit(False)), F.col("error").isNotNull()
    status = F.when(limited, "rate_limited").when(failed, "failed").otherwise("success")
    counts = {
        name: F.when(limited | failed, F.lit(0)).otherwise(F.coalesce(name, F.lit(0))).cast("bigint")
        for name in ("fetched", "new", "skipped")
    }
    return joined.withColumns({**counts, "status": status})


def stopped_runs(header: DataFrame, by: list[str]) -> DataFrame:
    """The runs whose records must not be stored: rate-limited or failed."""
    return header.where(F.coalesce("rate_limited", F.lit(False)) | F.col("error").isNotNull()).select(*by).distinct()


def open_runs(header: DataFrame) -> DataFrame:
    """The log entry written before a run starts."""
    zero = F.lit(0).cast("bigint")
    return header.select(
        "run_id", "topic", "method", zero.alias("fetched"), zero.alias("new_articles"),
        zero.alias("skipped_dupes"), F.lit("partial").alias("status"),
        F.lit(None).cast("string").alias("error_message"), "started_at",
        F.lit(None).cast("double").alias("duration_seconds"),
    )


def close_runs(counted: DataFrame) -> DataFrame:
    """The log entry written when a run is over."""
    return counted.select(
        "run_id", "topic", "method", "fetched", F.col("new").alias("new_articles"),
        F.col("skipped").alias("skipped_dupes"), "status", F.col("error").alias("error_message"),
        "started_at", "duration_seconds",
    )


def latest_runs(log: DataFrame) -> DataFrame:
    """One row per run: its closing entry, else the opening one (``partial``)."""
    entry = F.struct(*[c for c in log.columns if c != "run_id"])
    closed = F.when(F.col("status") == "partial", 0).otherwise(1)
    return log.groupBy("run_id").agg(F.max_by(entry, closed).alias("e")).select("run_id", "e.*")


def check_statuses(log: DataFrame) -> DataFrame:
    """The log itself; raises on a status outside the accepted four."""
    bad = log.where(F.col("status").isNull() | ~F.col("status").isin(*RUN_STATUSES)).select("status").limit(1)
    for row in bad.collect():
        raise FeedError(f"unknown run status: {row.status!r}")
    return log


def crawl_rollup(runs: DataFrame) -> DataFrame:
    return runs.groupBy("topic", "status").agg(
        F.count("*").alias("runs"),
        F.sum("fetched").alias("fetched"),
        F.sum("new_articles").alias("new_articles"),
        F.sum("skipped_dupes").alias("skipped_dupes"),
    )
