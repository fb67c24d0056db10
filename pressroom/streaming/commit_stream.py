"""Accepted articles as a stream: what follows the corpus commit by commit.

A commit row appears once its batch is complete, so a stream over the commit table sees each accepted
article once and no unfinished batch. Each step reads the committed daily counts of its batches, never the
articles, and writes folders named by its number, which a repeated step overwrites.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.skew import heavy_values, join_unique
from ..runtime import Scratch
from ..schema import COMMITS
from ..sources.corpus import Corpus

COUNTS = "topic STRING, day DATE, articles BIGINT, step BIGINT"
STATE = "step BIGINT, closed DATE"
ALERTS = "topic STRING, day DATE, articles BIGINT, threshold INT, webhook_url STRING, step BIGINT"


def follow_commits(corpus: Corpus, checkpoint: str, step: Callable[[DataFrame, int], None], commits_per_step: int = 100) -> StreamingQuery:
    """Call ``step`` with the new commit rows, some at a time, until there are no more."""
    commits = corpus.spark.readStream.option("maxFilesPerTrigger", commits_per_step).schema(COMMITS).parquet(corpus.commits_path())
    return commits.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class AcceptedAlerts:
    """Daily counts of accepted articles against thresholds, day by day as days close.

    A day closes when an article ``lateness_days`` newer has been accepted. Its alerts are written once; articles
    of closed days that come later are counted in a table of their own. Tables: ``counts`` (what came in time),
    ``late``, ``alerts`` and the steps' ``state``, all below ``root``.
    """

    def __init__(self, corpus: Corpus, root: str, screened: DataFrame, lateness_days: int = 2) -> None:
        self.corpus, self.spark, self.root, self.screened, self.lateness_days = corpus, corpus.spark, root.rstrip("/"), screened, lateness_days
        for name, schema in (("counts", COUNTS), ("late", COUNTS), ("alerts", ALERTS), ("state", STATE)):
            self.spark.createDataFrame([], schema).drop("step").write.mode("ignore").parquet(f"{self.root}/{name}/step=-1")

    def read(self, table: str) -> DataFrame:
        schema = {"counts": COUNTS, "late": COUNTS, "alerts": ALERTS, "state": STATE}[table]
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")

    def run(self, checkpoint: str, commits_per_step: int = 100) -> None:
        follow_commits(self.corpus, checkpoint, self.step, commits_per_step).awaitTermination()

    def step(self, commits: DataFrame, number: int) -> None:
        spark = self.spark
        # a repeated step must see the state before it
        before = self.read("state").where(F.col("step") < number).agg(F.max("closed")).first()[0]
        closed = F.lit(before).cast("date")
        batches = [r.batch for r in commits.select("batch").distinct().collect()]  # at most commits_per_step
        with Scratch(spark, "accepted") as scratch:
            new = scratch.cut(self.corpus.daily_of(batches).groupBy("topic", "day").agg(F.sum("articles").alias("articles")), "new")
            is_late = F.coalesce(F.col("day") <= closed, F.lit(False))
            self._write(new.where(is_late), "late", number)
            self._write(new.where(~is_late), "counts", number)
            latest = new.agg(F.date_sub(F.max("day"), self.lateness_days)).first()[0]
            now = max((d for d in (before, latest) if d is not None), default=None)
            days = self.read("counts").where((F.col("step") <= number) & (F.col("day") <= F.lit(now).cast("date")))
            if before is not None:
                days = days.where(F.col("day") > closed)
            counts = scratch.cut(days.groupBy("topic", "day").agg(F.sum("articles").alias("articles")), "days")
            wanted = self.screened.where("accepted").select("topic", "threshold", "webhook_url")
            # a topic has a row per closed day, so the days of a topic travel as one row
            per_topic = counts.groupBy("topic").agg(F.collect_list(F.struct("day", "articles")).alias("days"))
            met = join_unique(wanted, per_topic, "topic", heavy_values(wanted, "topic", scratch), "inner")
            met = met.select("topic", "threshold", "webhook_url", F.inline("days")).where(F.col("articles") >= F.col("threshold"))
            self._write(met.select("topic", "day", "articles", "threshold", "webhook_url"), "alerts", number)
            # last: a step without this row is run again
            self._write(spark.createDataFrame([(now,)], "closed date"), "state", number)

    def _write(self, rows: DataFrame, table: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/step={number}")
