"""Packing into optimal length buckets with token-budget batches.

The histogram of true lengths goes to the driver: D different lengths need D(D+1)/2 tokens at least, so it
has at most sqrt(2 * tokens) cells, some millions for a hundred terabytes of text. Dynamic programming then
chooses the boundaries with the least padding: best[k][j] = min over i of best[k-1][i] + padding of cells
i..j-1 under the boundary of cell j-1. The best i never falls as j grows, so each row is computed by halves,
in m log m steps rather than m squared.

Inside a bucket a batch has token_budget // boundary documents. A document longer than the
budget is a batch of its own: nothing is cut or dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.numbering import number_rows
from ..runtime import Scratch
from . import common

BUCKETS = 8
TOKEN_BUDGET = 65_536
DIRECT = 64  # cells of a row that are computed at once


def tokens(text: Column) -> Column:
    """Words and one end token."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


@dataclass(frozen=True)
class Plan:
    boundaries: list[int]
    padding: int


def _row(best: np.ndarray, cells: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """best[k] and the first best cut of each j from best[k-1]."""
    m = len(cells)
    now, cut = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    todo = [(k, m, k - 1, m - 1)]  # j from..to, cuts from..to
    while todo:
        low, high, first, last = todo.pop()
        if low > high:
            continue
        if high - low < DIRECT and (high - low + 1) * (last - first + 1) <= 1 << 20:
            j, i = np.arange(low, high + 1)[:, None], np.arange(first, last + 1)[None]
            cost = np.where(i < j, best[i] + cells[j - 1] * (c[j] - c[i]) - (s[j] - s[i]), np.iinfo(np.int64).max)
            at = cost.argmin(1)
            now[low:high + 1], cut[low:high + 1] = cost[np.arange(high - low + 1), at], first + at
            continue
        j = (low + high) // 2
        i = slice(first, min(last, j - 1) + 1)
        cost = best[i] + cells[j - 1] * (c[j] - c[i]) - (s[j] - s[i])
        at = first + int(cost.argmin())
        now[j], cut[j] = cost[at - first], at
        todo += [(low, j - 1, first, at), (j + 1, high, at, last)]
    return now, cut


def optimal(cells: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int = BUCKETS) -> Plan:
    """Boundaries (ascending cells) of at most ``buckets`` buckets with the least padding; of equal plans the one with the shortest buckets at the end split first."""
    m = len(cells)
    if not m:
        return Plan([], 0)
    c, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(sums)])
    best = np.concatenate([[0], cells * c[1:] - s[1:]])  # one bucket over cells 0..j
    cuts = []
    for k in range(2, min(buckets, m) + 1):
        best, cut = _row(best, cells, c, s, k)
        cuts.append(cut)
    at, ends = m, []
    for cut in reversed(cuts):
        ends.append(at)
        at = int(cut[at])
    ends.append(at)
    return Plan([int(cells[e - 1]) for e in reversed(ends)], int(best[m]))


def pack(docs: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, bucket, boundary, batch_id, slot, padding.

    Null and empty texts have one token. Rows are placed by (n_tokens, doc_id), null ids first; rows that
    repeat a doc_id are placed one after the other. Batch ids count from 0 over all buckets.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pack")
    rows = scratch.cut(docs.select("doc_id", tokens(F.col("text")).alias("n_tokens")), "lengths")
    held = rows.groupBy(F.col("n_tokens").alias("cell")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).orderBy("cell")
    cells, counts, sums = common.arrays(held)
    plan = optimal(cells, counts, sums, buckets)
    placed = number_rows(rows, ["n_tokens", "doc_id"], scratch, start=0, name="place")
    ends = plan.boundaries or [1]
    of = np.searchsorted(ends, cells)
    size = np.bincount(of, counts, len(ends)).astype(np.int64) if len(cells) else np.zeros(len(ends), np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    room = [max(1, token_budget // b) for b in ends]
    batches = np.concatenate([[0], np.cumsum(-(-size // np.array(room)))])

    def choose(values: list[int]) -> Column:
        out = F.lit(int(values[-1])).cast("long")
        for b, v in reversed(list(zip(ends[:-1], values))):
            out = F.when(F.col("n_tokens") <= b, F.lit(int(v)).cast("long")).otherwise(out)
        return out

    place = F.col("place") - choose(list(first[:-1]))
    return placed.select(
        "doc_id", "n_tokens", choose(list(range(len(ends)))).cast("int").alias("bucket"), choose(ends).alias("boundary"),
        (choose(list(batches[:-1])) + F.floor(place / choose(room))).cast("long").alias("batch_id"),
        (place % choose(room)).cast("int").alias("slot"), (choose(ends) - F.col("n_tokens")).alias("padding"),
    )
