"""Consecutive numbers in a given order without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import Scratch

_SHIFT = 33  # monotonically_increasing_id keeps the partition above bit 33


def number_rows(
    df: DataFrame, order: list[str], scratch: Scratch, start: int = 1, name: str = "id"
) -> DataFrame:
    """Add ``name`` = start, start + 1, ... in the order of ``order``.

    Rows are range-partitioned and sorted, numbered inside their partition and
    written. What then passes through one task is one row per partition: its
    size, turned into an offset.
    """
    mark = F.monotonically_increasing_id()
    placed = scratch.cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__mark", mark), "numbered"
    )
    part = F.shiftright("__mark", _SHIFT)
    place = F.col("__mark").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.lit(start) + F.col("__before") + place)
        .drop("__part", "__mark", "__before")
    )
