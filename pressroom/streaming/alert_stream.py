"""Daily topic volumes of a stream of accepted articles, against thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def daily_counts(accepted: DataFrame, lateness: str = "2 days") -> DataFrame:
    """(topic, date, articles) per closed day; rows later than ``lateness`` are dropped.

    Works on a stream (append mode) and on a batch, where every day is closed.
    """
    stamped = accepted.select("topic", F.col("published_at").cast("timestamp").alias("at")).where("at is not null")
    if accepted.isStreaming:
        stamped = stamped.withWatermark("at", lateness)
    grouped = stamped.groupBy(F.window("at", "1 day").alias("day"), "topic").agg(F.count("*").alias("articles"))
    return grouped.select("topic", F.date_format(F.col("day")["start"], "yyyy-MM-dd").alias("date"), "articles")


def alert_stream(accepted: DataFrame, screened: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Alerts (topic, date, articles, threshold, webhook_url) of accepted registrations.

    ``screened`` is a stored table, joined to each closed window.
    """
    wanted = screened.where("accepted").select("topic", "threshold", "webhook_url")
    return daily_counts(accepted, lateness).join(wanted, "topic").where(F.col("articles") >= F.col("threshold"))
