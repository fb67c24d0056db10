"""Topic-volume alerts as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..errors import WebhookRefused
from ..functions.text import truthy
from ..functions.webhooks import with_webhook_reason
from ..runtime import Scratch
from .skew import heavy_values, join_unique

DEFAULT_THRESHOLD = 5


def screen_registrations(registrations: DataFrame, allow_http: bool = False) -> DataFrame:
    """Registrations (topic, threshold, webhook_url) with ``reason`` and ``accepted``.

    No webhook is fine; an empty one counts as none. The threshold defaults.
    """
    screened = with_webhook_reason(registrations, "webhook_url", "reason", allow_http)
    no_hook = truthy(F.col("webhook_url")).isNull()
    return screened.withColumns({
        "threshold": F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD)),
        "reason": F.when(~no_hook, F.col("reason")),
    }).withColumn("accepted", F.col("reason").isNull())


def check_registrations(registrations: DataFrame, allow_http: bool = False) -> DataFrame:
    """Screened registrations; raises at the first refused webhook."""
    screened = screen_registrations(registrations, allow_http)
    for row in screened.where(~F.col("accepted")).limit(1).collect():
        raise WebhookRefused(f"{row.webhook_url!r}: {row.reason}")
    return screened


def topic_alerts(screened: DataFrame, new_articles: DataFrame, scratch: Scratch) -> DataFrame:
    """Accepted registrations whose topic has at least ``threshold`` new articles.

    ``screened`` is the stored outcome of ``screen_registrations``: webhooks
    are judged once, when they are registered. Topics with many registrations
    meet their count by broadcast.
    """
    counts = new_articles.groupBy("topic").agg(F.count("*").alias("articles"))
    wanted = screened.where("accepted")
    return (
        join_unique(wanted, counts, "topic", heavy_values(wanted, "topic", scratch), "inner")
        .where(F.col("articles") >= F.col("threshold"))
        .select("topic", "threshold", "webhook_url", "articles")
    )
