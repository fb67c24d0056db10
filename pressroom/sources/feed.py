"""Raw feed records and their normal form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import Settings
from ..functions.text import truthy
from ..operators.numbering import number_rows
from ..runtime import Scratch
from ..schema import RAW_FEED


def read_feed(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Raw feed files with the declared schema.

    In JSON the publisher is an object or a plain string; it is read as text
    and told apart here, so neither form is lost. Each record carries its place
    (file, split and, where the format knows it, row), from which ``arrival_order`` numbers feeds without ``ord``.
    """
    if fmt != "json":
        return with_place(spark.read.schema(RAW_FEED).format(fmt).load(path), fmt)
    return split_publisher(with_place(spark.read.schema(json_schema()).json(path), fmt))


PLACE = ("feed_file", "feed_split")
_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above
FEW_SPLITS = 200_000  # splits whose ranks are broadcast: some 40 MB


def with_place(raw: DataFrame, fmt: str) -> DataFrame:
    """Add where a record of a batch or a stream stands: its file, and its row in the file (Parquet) or its split of the file."""
    file = {"feed_file": F.col("_metadata.file_path")}
    if fmt == "parquet":
        return raw.withColumns({**file, "feed_split": F.lit(0).cast("long"), "feed_row": F.col("_metadata.row_index")})
    return raw.withColumns({**file, "feed_split": F.col("_metadata.file_block_start")})


def arrival_order(raw: DataFrame, scratch: Scratch, topics: Sequence[str] = ()) -> DataFrame:
    """Fill ``ord`` in the order of arrival: batch, place of the topic in ``topics``, file, row in the file.

    Topics that are not listed come after those that are, by name. Numbers grow but are not consecutive: what is ranked is one
    row per split of a file and topic, and the row inside the split is appended. A feed that brings ``ord`` in any record
    keeps it; one that brings it in some records only is refused when it is ingested. Rows of a format without row numbers
    are numbered by the task that reads them; such a feed is written once, so that all later scans see the same numbers.
    """
    if not set(PLACE) <= set(raw.columns):
        return raw
    listed = F.lit(len(topics))
    for i, topic in reversed(list(enumerate(topics))):
        listed = F.when(F.col("topic") == topic, F.lit(i)).otherwise(listed)
    by = ["batch", "topic", *PLACE]
    groups = scratch.cut(raw.groupBy(*by).agg(F.count("ord").alias("__given")), "splits")
    if groups.agg(F.sum("__given")).first()[0]:
        return raw
    if "feed_row" not in raw.columns:
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        raw = scratch.cut(raw.withColumn("feed_row", row), "placed")
    ranks = number_rows(groups.withColumn("__listed", listed), ["batch", "__listed", "topic", *PLACE], scratch, name="__rank")
    ranks = scratch.cut(ranks.select("__rank", *[F.col(c).alias(f"__{c}") for c in by]), "ranks")
    match = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    joined = raw.join(F.broadcast(ranks) if ranks.count() <= FEW_SPLITS else ranks, match)
    return joined.withColumn("ord", F.col("__rank") * (1 << _ROW_BITS) + F.col("feed_row")).select(*raw.columns)


def json_schema() -> str:
    return RAW_FEED.replace("publisher STRUCT<title: STRING, href: STRING>", "publisher STRING")


def split_publisher(raw: DataFrame) -> DataFrame:
    """Publisher text of a JSON feed as struct or as plain name."""
    shape = "title STRING, href STRING"
    is_object = F.startswith(F.col("publisher"), F.lit("{"))
    return raw.withColumns({
        "publisher_text": F.coalesce(F.col("publisher_text"), F.when(~is_object, F.col("publisher"))),
        "publisher": F.when(is_object, F.from_json("publisher", shape)),
    })


def publisher_name(struct: Column, plain: Column) -> Column:
    """Struct title, else struct address, else the plain name."""
    return F.coalesce(truthy(struct["title"]), struct["href"], truthy(plain))


def normalise_feed(raw: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per record with article column names and default place.

    Country and language fall back only where absent; an empty text stays.
    """
    return raw.select(
        "batch", "method", "topic", "ord", "title", "url",
        F.col("description").alias("summary"),
        F.coalesce(truthy(F.col("published date")), F.col("published_date")).alias("published_date"),
        publisher_name(F.col("publisher"), F.col("publisher_text")).alias("publisher_name"),
        F.col("publisher")["href"].alias("publisher_href"),
        F.coalesce("country", F.lit(settings.country)).alias("country"),
        F.coalesce("language", F.lit(settings.language)).alias("language"),
        "full_text",
        F.lit(settings.embed_model).alias("embed_model"),
        F.lit(settings.embed_dim).alias("embed_dim"),
    )


def is_valid() -> Column:
    """Rows worth storing have a title and a URL; a blank title counts as one."""
    return truthy(F.col("title")).isNotNull() & truthy(F.col("url")).isNotNull()


def method_counts(feed: DataFrame) -> DataFrame:
    return feed.groupBy("method").agg(F.count("*").alias("records"))
