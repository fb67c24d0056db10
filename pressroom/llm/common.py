"""Helpers that several training-data operators share.

Texts reach Python tasks as Arrow batches. ``pieces`` cuts a batch into runs of
whole documents of about a megabyte, and the array helpers below work on the
concatenated bytes of such a run, so memory follows the longest document and
never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PIECE_BYTES = 1 << 20
PIECE_DOCS = 20_000
BROADCAST_ROWS = 400_000  # of one or two 8-byte columns: some 10 MB in memory


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def remainder(key: str, modulus: int) -> Column:
    """crc32 of a key written as text, modulo ``modulus``; a null key counts as -1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus, F.lit(-1))


def without(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``listed`` (one column, same name; a written table).

    A short list is broadcast so that wide rows stay where they are; beyond
    BROADCAST_ROWS the same anti-join shuffles. Null keys are never listed.
    """
    few = listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(listed) if few else listed, key, "left_anti")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values and their n + 1 borders; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, borders, data = column.buffers()
    ends = np.frombuffer(borders, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[ends[0]:ends[-1]], ends - ends[0]


def pieces(borders: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents with about ``limit`` bytes, at least one document each."""
    i, n = 0, len(borders) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(borders, borders[i] + limit, "right")) - 1)
        j = min(j, i + PIECE_DOCS)
        yield i, j
        i = j


def byte_table(pairs: dict[int, int] | None = None) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    for a, b in (pairs or {}).items():
        table[a] = b
    return table


LOWER = byte_table({c: c + 32 for c in range(65, 91)})
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of every run of bytes that are not white space."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[borders] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(borders, starts, "right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of the splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(21, (n - 1).bit_length())
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(up), np.cumprod(down)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, the same wherever the span stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


_MIX = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(hashes: np.ndarray, doc: np.ndarray, width: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every ``width`` consecutive words of one document.

    A document with fewer words gives its whole sequence as one shingle, one
    without words gives none.
    """
    counts = np.bincount(doc, minlength=n_docs)
    total = len(hashes)
    out = np.zeros(total, np.uint64)
    for k in range(min(width, total)):
        out[:total - k] = out[:total - k] * _MIX[32] + hashes[k:] * _MIX[k]
    first = np.concatenate([[0], np.cumsum(counts)])
    left = first[doc + 1] - np.arange(total)  # words from here to the end of the document
    full = left >= width
    short = np.flatnonzero((counts > 0) & (counts < width))
    extra = np.zeros(len(short), np.uint64)
    for at, d in enumerate(short):
        h = np.uint64(counts[d])
        for w in hashes[first[d]:first[d + 1]]:
            h = mixed(np.array([h]) * _MIX[40] + w)[0]
        extra[at] = h
    got = np.concatenate([mixed(out[full]), extra])
    of = np.concatenate([doc[full], short])
    order = np.argsort(of, kind="stable")
    return got[order], of[order]


def arrays(rows: DataFrame) -> list[np.ndarray]:
    """The columns of a small result, over Arrow whatever the session's settings."""
    table = rows.toArrow()
    return [table.column(c).to_numpy() for c in rows.columns]


BITMAP_BITS = 26  # 8 MB, whatever the input


def bitmap(marks: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of 2^bits cells; the cells at the top bits of column ``mark`` are set.

    A driver-side array of fixed size: what reaches the driver is at most one
    row for 64 cells.
    """
    cell = F.shiftrightunsigned("mark", 64 - bits)
    held = marks.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits")
    )
    word, set_ = arrays(held)
    out = np.zeros(1 << (bits - 6), np.int64)
    out[word] = set_
    return out.view(np.uint64)


def hits(marks: np.ndarray, held: np.ndarray, bits: int = BITMAP_BITS) -> np.ndarray:
    """Which marks (uint64) fall on a set cell."""
    cell = marks >> np.uint64(64 - bits)
    return (held[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) != 0
