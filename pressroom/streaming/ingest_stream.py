"""The feed as a stream of files, ingested micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..plans.ingest import Embed, ingest_into
from ..schema import RAW_FEED
from ..sources.corpus import Corpus
from ..sources.feed import json_schema, split_publisher, with_place


def stream_feed(spark: SparkSession, path: str, fmt: str = "json", files_per_batch: int = 1000) -> DataFrame:
    """Raw feed files below ``path`` as a stream with the declared schema; each record carries its place, as in ``read_feed``."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    if fmt == "json":
        return split_publisher(with_place(reader.schema(json_schema()).json(path), fmt))
    return with_place(reader.schema(RAW_FEED).format(fmt).load(path), fmt)


def ingest_stream(
    raw: DataFrame,
    corpus: Corpus,
    checkpoint: str,
    as_of: str,
    embed: Embed,
    settings: Settings = Settings(),
    name: str = "stream",
) -> StreamingQuery:
    """Ingest everything there is now; each micro-batch is one corpus batch.

    The micro-batch number names the corpus batch. A micro-batch that is run
    again after a failure is found committed, or overwrites its own folders,
    so every record counts once. Micro-batches give the result of one large
    batch as long as they arrive in the order of ``ord``. Records without ``ord``
    are numbered inside their micro-batch; article ids go on where the last
    commit ended, so the order of the files holds across micro-batches.
    """

    def step(rows: DataFrame, number: int) -> None:
        # Several jobs read the micro-batch; its files are simply read again.
        ingest_into(corpus, f"{name}-{number:012d}", rows, as_of, embed, settings)

    return (
        raw.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
