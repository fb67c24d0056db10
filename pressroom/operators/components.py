"""Connected components of links between numbered nodes, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import Scratch
from .skew import SHARE, join_unique

MOST_ROUNDS = 60
FLOOR_LINKS = 20_000  # links below which no node is looked at for being a hub


def _with_low(rows: DataFrame, low: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """``rows`` with the ``low`` of their node ``a``; ``low`` counts each node's rows as ``n``.

    A hub has more than 1/SHARE of the rows, so there are fewer than SHARE of them: their lows are broadcast, and only
    the rows of other nodes are shuffled by node.
    """
    if total <= FLOOR_LINKS:
        return rows.join(low.drop("n"), "a")
    low = scratch.cut(low, "low")
    hubs = low.where(F.col("n") > max(FLOOR_LINKS // SHARE, total // SHARE)).select("a")
    return join_unique(rows, low.drop("n"), "a", None if hubs.isEmpty() else hubs, "inner", total)


def _size(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b), for nodes that have links.

    Rounds of the large-star and small-star steps: each node's neighbours are tied to the smallest of
    them, first those above it, then those below. A round halves the depth of what is left; nothing is
    collected but one number. Every round's links are a written table. Neighbours of a hub stay where they are.
    """
    links = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = scratch.cut(links, "links")
    size = _size(links)
    for _ in range(MOST_ROUNDS):
        total = 2 * size[0]
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"), F.count("*").alias("n"))
        # large star: neighbours above a node go to the smallest neighbour (or the node)
        large = _with_low(both.where("b > a"), low, total, scratch).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # small star: neighbours below a node, and the node, go to the smallest neighbour
        if total > FLOOR_LINKS:
            large = scratch.cut(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        tied = _with_low(large, least, total, scratch)
        small = tied.select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b")).where("a != b").distinct()
        links, before = scratch.cut(small, "links"), size
        size = _size(links)
        if size == before:
            tops = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
    raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
