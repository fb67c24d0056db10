"""Line dedup over a sharded minimal perfect hash.

All distinct line keys, as 128-bit hashes, are dealt to shards by their top bits. A shard's task builds a
minimal perfect hash of its keys: on each level a key sits in the cell that it has alone, the others go on
to a smaller level, and the rank of a set cell is the key's place. Places index three compact arrays: a
32-bit fingerprint, a saturating count of documents, and for keys of two documents or more the smallest
document. Documents send their line hashes to the shards and probe the arrays; no line text is ever joined.

Keys that hold more than 1/HEAD_KEYS of all lines are fewer than HEAD_KEYS: their arrays (some 1 MB) are
broadcast, so a line of a third of all documents is settled where its documents are. A shard's probes
arrive behind its arrays in one sorted stream, which Spark spills; nothing of a shard is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import Scratch
from . import common

LEAST_POINTS = 10
HEAD_KEYS = 1 << 16
SHARD_KEYS = 1 << 16
SHARD_PROBES = 1 << 20
GAMMA = 2  # cells for a key on a level
MOST_LEVELS = 64
MOST_COUNT = 255
NO_ID = (1 << 63) - 1
PIECE_ROWS = 1 << 17
BLANK = b" \t\n\v\f\r"


def _cells(h: np.ndarray, g: np.ndarray, level: int, size: int) -> np.ndarray:
    return (common.mixed(h + common.mixed(g + np.uint64(level + 1))) % np.uint64(size)).astype(np.int64)


@dataclass(frozen=True)
class Arrays:
    """A minimal perfect hash of n keys and what its places index."""

    sizes: np.ndarray  # cells of each level, multiples of 64
    words: np.ndarray  # the cells of all levels, one bit each
    marks: np.ndarray
    counts: np.ndarray
    keeps: np.ndarray  # smallest document, for the places with a count of two or more

    @staticmethod
    def build(h: np.ndarray, g: np.ndarray, counts: np.ndarray, keeps: np.ndarray) -> Arrays:
        """Arrays of distinct keys (uint64 pairs)."""
        sizes, levels, place = [], [], np.zeros(len(h), np.int64)
        rest, base = np.arange(len(h)), 0
        while len(rest):
            if len(sizes) == MOST_LEVELS:
                raise ValueError("keys of a minimal perfect hash must be distinct")
            size = -(-GAMMA * len(rest) // 64) * 64
            cell = _cells(h[rest], g[rest], len(sizes), size)
            alone = np.bincount(cell, minlength=size) == 1
            sits = alone[cell]
            place[rest[sits]] = base + (np.cumsum(alone) - 1)[cell[sits]]
            base += int(sits.sum())
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            rest = rest[~sits]
        at = np.argsort(place)
        few = np.minimum(counts[at], MOST_COUNT).astype(np.uint8)
        return Arrays(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, np.uint64),
                      (g[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32), few, keeps[at][few > 1])

    def probe(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and smallest document of each key; a count of 0 for keys that are not held, no document below 2."""
        counts, keeps = np.zeros(len(h), np.int64), np.full(len(h), NO_ID, np.int64)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        nth = np.concatenate([[0], np.cumsum(self.counts > 1)])
        rest, word = np.arange(len(h)), 0
        for level, size in enumerate(self.sizes.tolist()):
            cell = _cells(h[rest], g[rest], level, size)
            at, bit = word + (cell >> 6), (cell & 63).astype(np.uint64)
            here = (self.words[at] >> bit) & np.uint64(1) != 0
            some, at, bit = rest[here], at[here], bit[here]
            place = before[at] + np.bitwise_count(self.words[at] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            same = self.marks[place] == (g[some] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            some, place = some[same], place[same]
            counts[some] = self.counts[place]
            many = counts[some] > 1
            keeps[some[many]] = self.keeps[nth[place[many]]]
            rest, word = rest[~here], word + size // 64
        return counts, keeps

    def packed(self) -> list[bytes]:
        return [x.tobytes() for x in (self.sizes, self.words, self.marks, self.counts, self.keeps)]

    @staticmethod
    def unpacked(blobs: list[bytes]) -> Arrays:
        return Arrays(*(np.frombuffer(b, t) for b, t in zip(blobs, (np.int64, np.uint64, np.uint32, np.uint8, np.int64))))


BLOBS = ["sizes", "words", "marks", "counts", "keeps"]


def hash_of(line: bytes, least: int) -> bytes | None:
    """128-bit hash of a line's key, or None for keys with fewer than ``least`` code points."""
    key = line.strip(BLANK).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode()) < least:
        return None
    return xxhash.xxh3_128_digest(key)


def _pairs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, at = common.flat(batch.column("text"))
    whole = memoryview(data)
    return (bytes(whole[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist()))


def _lines(least: int):
    """The distinct line hashes of each row: (k, t, h, g)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit():
            h, g = _pairs(held)
            n = np.array(sizes)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(x, n)) for x in (np.array(ks, np.int64), np.array(ts, np.int64))]
                                              + [pa.array(h.view(np.int64)), pa.array(g.view(np.int64))], names=["k", "t", "h", "g"])

        held, sizes, ks, ts = [], [], [], []
        for batch in batches:
            for k, t, text in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), _texts(batch)):
                found = {hash_of(line, least) for line in text.split(b"\n")}
                found.discard(None)
                if found:
                    held += found
                    sizes.append(len(found)), ks.append(k), ts.append(t)
                if len(held) >= PIECE_ROWS:
                    yield emit()
                    held, sizes, ks, ts = [], [], [], []
        if held:
            yield emit()

    return run


def _built(table: pa.Table) -> pa.Table:
    h, g, n, keep = (table.column(c).to_numpy() for c in ("h", "g", "n", "keep"))
    blobs = Arrays.build(h.view(np.uint64), g.view(np.uint64), n, keep).packed()
    return pa.table({"shard": table.column("shard").slice(0, 1)} | {c: pa.array([b], pa.binary()) for c, b in zip(BLOBS, blobs)})


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines to drop, from a stream sorted by shard with the arrays of a shard before its probes."""
    shard, arrays = None, None
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        borders = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
        for i, j in zip(borders, borders[1:]):
            part = batch.slice(i, j - i)
            if part.column("words")[0].is_valid:
                shard, arrays = shards[i], Arrays.unpacked([part.column(c)[0].as_py() for c in BLOBS])
                part = part.slice(1)
            elif shard != shards[i]:
                raise ValueError(f"no arrays of shard {shards[i]}")
            if not part.num_rows:
                continue
            k, t, h, g = (part.column(c).to_numpy() for c in ("k", "t", "h", "g"))
            counts, keeps = arrays.probe(h.view(np.uint64), g.view(np.uint64))
            gone = (counts > 1) & (keeps != k)
            if gone.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[gone]) for x in (k, t, h, g)], names=["k", "t", "h", "g"])


def _not_in_head(shared):
    """Probes whose key the broadcast arrays do not settle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = Arrays.unpacked(shared.value)
        for batch in batches:
            h, g = (batch.column(c).to_numpy().view(np.uint64) for c in ("h", "g"))
            yield batch.filter(pa.array(head.probe(h, g)[0] == 0))

    return run


def _marked(shared):
    """Rows whose mark hits the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(common.hits(batch.column("mark").to_numpy().view(np.uint64), shared.value)))

    return run


def _kept(head, bits, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row's text without the lines that the head or its own list drops; with ``bits``, only rows off the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays.unpacked(head.value)
        for batch in batches:
            if bits is not None:
                batch = batch.filter(pa.array(~common.hits(batch.column("mark").to_numpy().view(np.uint64), bits.value)))
            for i in range(0, batch.num_rows, common.PIECE_DOCS):
                yield from _cut(batch.slice(i, common.PIECE_DOCS), arrays, least)

    return run


def _cut(batch: pa.RecordBatch, arrays: Arrays, least: int) -> Iterator[pa.RecordBatch]:
    _, at = common.flat(batch.column("text"))
    for i, j in common.pieces(at):
        part = batch.slice(i, j - i)
        lines = [text.split(b"\n") for text in _texts(part)]
        marks = [hash_of(line, least) for some in lines for line in some]
        of = np.repeat(part.column("k").to_numpy(), [len(x) for x in lines])
        keyed = np.flatnonzero(np.array([m is not None for m in marks], bool))
        gone = np.zeros(len(marks), bool)
        if len(keyed):
            counts, keeps = arrays.probe(*_pairs([marks[x] for x in keyed.tolist()]))
            gone[keyed] = (counts > 1) & (keeps != of[keyed])
        out, dropped, first = [], [], 0
        lists = part.column("gone") if "gone" in part.schema.names else None
        for n, some in enumerate(lines):
            flags = gone[first:first + len(some)].tolist()
            if lists is not None and lists[n].is_valid:
                listed = {x["h"].to_bytes(8, "little", signed=True) + x["g"].to_bytes(8, "little", signed=True) for x in lists[n].as_py()}
                flags = [f or marks[first + x] in listed for x, f in enumerate(flags)]
            out.append(b"\n".join(line for line, f in zip(some, flags) if not f))
            dropped.append(sum(flags))
            first += len(some)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array([len(x) for x in lines], pa.int64()), pa.array(dropped, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_lines", "n_dropped", "kept_text"])


def _shard(bits: int) -> Column:
    return F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")


def _drops(rows: DataFrame, least: int, work: Scratch, scratch: Scratch):
    """The broadcast arrays of the most frequent keys, and (k, t, gone) with the other lines that a text loses."""
    held = work.cut(rows.select("k", "t", "text").mapInArrow(_lines(least), "k long, t long, h long, g long"), "held")
    n = F.when(F.min("k") == F.max("k"), F.lit(1)).otherwise(F.greatest(F.count("*"), F.lit(2))).cast("long")
    distinct = work.cut(held.groupBy("h", "g").agg(n.alias("n"), F.min("k").alias("keep")), "distinct")

    total, keys = held.count(), distinct.count()
    top = distinct.where(F.col("n") > max(1, total // HEAD_KEYS))
    h, g, counts, keeps = common.arrays(top.select("h", "g", "n", "keep"))
    packed = Arrays.build(h.view(np.uint64), g.view(np.uint64), counts, keeps).packed()
    head = rows.sparkSession.sparkContext.broadcast(packed)
    bits = (max(1, keys // SHARD_KEYS, total // SHARD_PROBES) - 1).bit_length()

    arrays = distinct.select(_shard(bits).alias("shard"), "h", "g", "n", "keep").groupBy("shard").applyInArrow(
        _built, "shard long, " + ", ".join(f"{c} binary" for c in BLOBS))
    probes = held.mapInArrow(_not_in_head(head), held.schema).withColumn("shard", _shard(bits))
    stream = work.cut(arrays, "arrays").unionByName(probes, allowMissingColumns=True)
    stream = stream.repartition("shard").sortWithinPartitions("shard", F.col("words").isNull())
    drops = stream.mapInArrow(_probed, "k long, t long, h long, g long")
    # copies of a row send the same list, so a set stays as small as one text
    return head, scratch.cut(drops.groupBy("k", "t").agg(F.collect_set(F.struct("h", "g")).alias("gone")), "drops")


def line_dedup(docs: DataFrame, least: int = LEAST_POINTS, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_lines, n_dropped, kept_text.

    A line's key is the line without white space at its ends, A-Z lower-cased. A key of at least ``least`` code points
    that two doc_ids hold loses all its lines but those of the smallest doc_id. Null and empty texts are one empty line,
    which stays. Rows that repeat a doc_id are one document: they lose no line to one another. Rows with a null doc_id are
    one document behind all others. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lines")
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select("doc_id", "text", k.alias("k"), F.xxhash64("text").alias("t"))
    with Scratch(spark, "line-index") as work:
        head, drops = _drops(rows, least, work, scratch)

    # only texts that may lose a line travel to their list; the bitmap has a fixed size
    rows = rows.withColumn("mark", F.xxhash64("k", "t"))
    some = spark.sparkContext.broadcast(common.bitmap(drops.select(F.xxhash64("k", "t").alias("mark"))))
    out = "doc_id {}, n_lines long, n_dropped long, kept_text string".format(docs.schema["doc_id"].dataType.simpleString())
    listed = rows.mapInArrow(_marked(some), rows.schema).join(drops, ["k", "t"], "left")
    return listed.mapInArrow(_kept(head, None, least), out).unionByName(rows.mapInArrow(_kept(head, some, least), out))
