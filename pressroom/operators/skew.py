"""Joins to a side with unique keys that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import Scratch

# A heavy value has more than 1/SHARE of the rows, so there are fewer than
# SHARE of them: what is broadcast below does not grow with the data.
SHARE = 2000
FLOOR_ROWS = 200_000
BROADCAST_ROWS = 100_000  # rows of a table that Spark may broadcast whole, by its own choice


def shuffled(side: DataFrame, rows: int) -> DataFrame:
    """One side of a join whose tables have up to ``rows`` rows; beyond BROADCAST_ROWS the join has to shuffle.

    Spark goes by file sizes, which say little about keys that compress well: millions of rows would pass through the driver.
    """
    return side if rows <= BROADCAST_ROWS else side.hint("merge")


def heavy_values(
    rows: DataFrame, column: str, scratch: Scratch, floor_rows: int = FLOOR_ROWS, total: int | None = None
) -> DataFrame | None:
    """Values with more rows than ``max(floor_rows, total / SHARE)``; None if there are none.

    Counts are combined before the shuffle, so a heavy value costs no more
    than any other. Small inputs cannot hold one and are not counted at all.
    """
    total = rows.count() if total is None else total
    if total <= floor_rows:
        return None
    limit = max(floor_rows, total // SHARE)
    heavy = scratch.cut(
        rows.groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(column),
        f"heavy-{column}",
    )
    return None if heavy.isEmpty() else heavy


def join_unique(
    rows: DataFrame, unique: DataFrame, column: str, heavy: DataFrame | None, how: str, most: int = 0
) -> DataFrame:
    """Join ``rows`` to a side with one row per value of ``column``.

    Rows with a heavy value meet their one partner by broadcast (fewer than
    SHARE rows) and stay where they are; only the others are shuffled.
    ``how`` is inner, left, left_semi or left_anti; ``most``: rows that ``unique`` may have, if known (see ``shuffled``).
    """
    if heavy is None:
        return rows.join(shuffled(unique, most), column, how)
    few = F.broadcast(heavy)
    hot = rows.join(few, column, "left_semi")
    cold = rows.join(few, column, "left_anti")
    hot_side = F.broadcast(unique.join(few, column, "left_semi"))
    return cold.join(shuffled(unique, most), column, how).unionByName(hot.join(hot_side, column, how))
