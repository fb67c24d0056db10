"""Exact dedup with counting quotient filters.

1. One pass digests every text (normalised bytes: SHA-256 and a 64-bit fingerprint).
2. Each partition turns its fingerprints into counting quotient filters, one per
   range of the fingerprint space: the quotient picks a run, the run holds sorted
   remainders, each with a counter. A fingerprint that a third of all rows share
   is one slot with a large counter.
3. The filters of a range meet in one task and merge losslessly by their sorted
   remainders. Ranges are so many that a task merges some RANGE_ROWS slots.
4. Fingerprints with a merged count above one go to byte verification: the rows
   that hit a bitmap of them (fixed size) are combined per text inside each task,
   then grouped by SHA-256, and the smallest and largest text of every group must
   agree byte for byte. False hits of the bitmap end as groups of one row.

Null text counts as empty. Rows with one doc_id are rows of their own: each is
returned and counted. A null doc_id ranks below all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..runtime import Scratch
from . import common

RANGE_ROWS = 250_000
LEAST_RANGES = 64
FLUSH_BYTES = 8 << 20


def build_filter(fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """Counting quotient filter of sorted distinct fingerprints of ``bits`` bits.

    Layout: quotient bits, then the run lengths of all quotients, the remainders
    in order, and the counters.
    """
    q = min(bits, max(1, int(len(fingerprints)).bit_length()))
    shift = np.uint64(bits - q)
    runs = np.bincount((fingerprints >> shift).astype(np.int64), minlength=1 << q).astype(np.uint32)
    rest = fingerprints & np.uint64((1 << (bits - q)) - 1)
    return b"".join((q.to_bytes(1, "little"), runs.tobytes(), rest.tobytes(), counts.astype(np.uint64).tobytes()))


def read_filter(blob: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints in order and their counts."""
    q = blob[0]
    runs = np.frombuffer(blob, np.uint32, 1 << q, 1)
    n, at = int(runs.sum()), 1 + (4 << q)
    rest = np.frombuffer(blob, np.uint64, n, at)
    counts = np.frombuffer(blob, np.uint64, n, at + 8 * n)
    quotients = np.repeat(np.arange(1 << q, dtype=np.uint64), runs)
    return (quotients << np.uint64(bits - q)) | rest, counts


def merge_sorted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of sorted (fingerprint, count) lists: one merge by the sorted remainders."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")  # a merge of runs that are already in order
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = common.flat(batch.column("text"))
        whole = memoryview(data)
        sha, marks = [], np.empty(len(batch), np.uint64)
        for i in range(len(batch)):
            norm = bytes(whole[at[i]:at[i + 1]]).lower()  # bytes.lower touches A-Z only
            sha.append(hashlib.sha256(norm).hexdigest())
            marks[i] = xxhash.xxh3_64_intdigest(norm)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sha, pa.string()), pa.array(marks.view(np.int64))],
            names=["doc_id", "text_sha256", "mark"],
        )


def _filters(ranges: int):
    """Per partition: one filter for each range of fingerprints that occurs."""
    bits = 64 - (ranges - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def emit():
            keys, counts = merge_sorted(held)
            of = (keys >> np.uint64(bits)).astype(np.int64)
            names, first = np.unique(of, return_index=True)
            borders = [*first, len(keys)]
            low = np.uint64((1 << bits) - 1)
            blobs = [build_filter(keys[i:j] & low, counts[i:j], bits) for i, j in zip(borders, borders[1:])]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["range", "filter"])

        for batch in batches:
            marks = batch.column("mark").to_numpy(zero_copy_only=False).view(np.uint64)
            held.append(np.unique(marks, return_counts=True))
            size += len(held[-1][0])
            if size > 4 * RANGE_ROWS:
                yield emit()
                held, size = [], 0
        if held:
            yield emit()

    return run, bits


def _merged(bits: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, counts = merge_sorted([read_filter(b.as_py(), bits) for b in table.column("filter")])
        many = counts > 1
        whole = keys[many] | (np.uint64(key[0].as_py()) << np.uint64(bits))
        return pa.table({"mark": whole.view(np.int64), "n": counts[many].astype(np.int64)})

    return run


def repeated_marks(narrow: DataFrame, scratch: Scratch) -> DataFrame:
    """Fingerprints that occur more than once, from merged quotient filters: (mark, n)."""
    ranges = 1 << (max(LEAST_RANGES, narrow.count() // RANGE_ROWS) - 1).bit_length()
    build, bits = _filters(ranges)
    blobs = narrow.select("mark").mapInArrow(build, "range long, filter binary")
    return scratch.cut(blobs.groupBy("range").applyInArrow(_merged(bits), "mark long, n long"), "repeated")


def _candidates(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        held: dict[bytes, list] = {}
        size = 0

        def emit():
            rows = list(held.items())
            return pa.RecordBatch.from_arrays(
                [pa.array([hashlib.sha256(t).hexdigest() for t, _ in rows], pa.string()), pa.array([t for t, _ in rows], pa.binary()),
                 pa.array([x[0] for _, x in rows], pa.int64()), pa.array([x[1] for _, x in rows], pa.int64())],
                names=["text_sha256", "norm", "n", "top"],
            )

        for batch in batches:
            data, at = common.flat(batch.column("text"))
            whole, ids = memoryview(data), batch.column("doc_id").to_pylist()
            norms = (bytes(whole[at[i]:at[i + 1]]).lower() for i in range(len(ids)))
            marks = np.array([xxhash.xxh3_64_intdigest(x) for x in norms], np.uint64)
            for i in np.flatnonzero(common.hits(marks, bits)).tolist():
                doc_id, norm = ids[i], bytes(whole[at[i]:at[i + 1]]).lower()
                if (seen := held.get(norm)) is None:
                    held[norm] = [1, doc_id]
                    size += len(norm)
                else:
                    seen[0] += 1
                    seen[1] = doc_id if seen[1] is None else seen[1] if doc_id is None else max(seen[1], doc_id)
                if size > FLUSH_BYTES:
                    yield emit()
                    held, size = {}, 0
        if held:
            yield emit()

    return run


def exact_groups(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. The row with the
    largest doc_id of equal texts stays. Rows that repeat a doc_id with an equal
    text are all marked kept when theirs is the largest; ``exact_dedup`` leaves one.
    """
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    docs = docs.select("doc_id", "text")
    narrow = scratch.cut(docs.mapInArrow(_digests, "doc_id long, text_sha256 string, mark long"), "digests")
    shared = docs.sparkSession.sparkContext.broadcast(common.bitmap(repeated_marks(narrow, scratch)))
    rows = docs.mapInArrow(_candidates(shared), "text_sha256 string, norm binary, n long, top long")
    groups = rows.groupBy("text_sha256").agg(
        F.sum("n").alias("n"), F.max("top").alias("keep_id"), F.min("norm").alias("lo"), F.max("norm").alias("hi")
    ).where("n > 1").select(
        "text_sha256", "keep_id",
        F.when(F.col("lo") == F.col("hi"), F.col("n")).otherwise(
            F.raise_error(F.concat(F.lit("two texts with one SHA-256: "), F.col("text_sha256"))).cast("long")
        ).alias("n"),
    )
    groups = scratch.cut(groups, "groups")
    joined = narrow.join(groups, "text_sha256", "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def exact_dedup(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Rows of ``docs`` without exact copies; all columns stay.

    Of rows that repeat one doc_id with an equal text one stays. Rows with a
    null doc_id stay only if no other row has their text, and then once.
    """
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    marked = scratch.cut(exact_groups(docs, scratch), "marked")
    gone = scratch.cut(marked.where("not kept and doc_id is not null").select("doc_id").distinct(), "gone")
    left = marked.where("doc_id is not null").groupBy("doc_id").agg(F.count_if("kept").alias("n"), F.count("*").alias("all")).where("n > 1 or n = 1 and all > 1")
    nulls = marked.where("doc_id is null")
    again = scratch.cut(left.select("doc_id").union(nulls.select("doc_id").limit(1)), "again")
    rest = common.without(docs, gone, "doc_id")
    if again.isEmpty():
        return rest
    # Repeated ids with a kept row, or none: these few rows are settled one by one through their digest.
    listed = again.where("doc_id is not null")
    norm = F.sha2(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256)
    some = docs.join(listed, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    keep = marked.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    some = some.withColumn("__sha2", norm).dropDuplicates(["doc_id", "__sha2"])
    some = some.join(keep, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__sha2") == F.col("__sha")), "left_semi")
    return common.without(rest.where("doc_id is not null"), listed, "doc_id").unionByName(some.drop("__sha2"))
