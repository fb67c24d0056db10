"""Prefix trie of conversations, with subtree totals by time-forward processing.

A prefix is named by a rolling hash of its turns' digests modulo 2^127 - 1. Turns are sorted by range and
each task walks its range once; a conversation that runs over several ranges is carried on through the one
row that each range leaves behind, because such hashes combine. So no conversation is ever collected, however
many turns it has, and texts are reduced to digests where they are read.

Totals flow from the leaves to the root. Nodes are cut into shards: a shard of tier t is a largest subtree
with at most FIRST * STEP^t conversations, without what belongs to lower tiers. A shard's nodes come sorted in
reverse level order; each node takes the messages addressed to it out of a priority queue, adds its own and
sends the total to its parent. The shard's root sends to a node of a higher tier, where messages are summed
per node before they are delivered. Pending messages stand for disjoint subtrees, so a queue holds at most
FIRST, or STEP in higher tiers, whatever the size of the trie; above SPILL messages it moves sorted runs out
of its heap into packed arrays. Nodes of one conversation have closed totals and send only a count.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import SHARE, join_unique
from ..runtime import Scratch

GROUP = 20  # conversations that share their first turns
LONGEST = 4  # the number of shared turns is crc32 modulo this
FIRST = 1024
STEP = 32
SPILL = 4096
MODULUS = (1 << 127) - 1
BASE = 0x3C6EF372FE94F82BA54FF53A5F1D36F1
ROOT = (1).to_bytes(16, "big")  # the hash of no turns
PART = 33  # monotonically_increasing_id keeps the partition above bit 33
PIECE_IDS = 50_000


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of each row in the run of its conversation, in a sorted stream; ``first``: the run opens the stream."""
    last, count, first = None, 0, True
    for batch in batches:
        c = batch.column("c").to_numpy()
        if not len(c):
            continue
        starts = np.flatnonzero(np.concatenate([[last is None or c[0] != last], c[1:] != c[:-1]]))
        n = np.arange(1, len(c) + 1)
        lead = starts[0] if len(starts) else len(c)
        n[:lead] += count
        n[lead:] -= np.repeat(starts, np.diff(np.append(starts, len(c))))
        opening = np.zeros(len(c), bool)
        if first:
            others = starts[1:] if last is None else starts
            stop = others[0] if len(others) else len(c)
            opening[:stop], first = True, stop == len(c)
        last, count = c[-1], n[-1]
        yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(n), batch.column("digest"), batch.column("words"), pa.array(opening)], names=["c", "n", "digest", "words", "first"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_numbered``, with the hash of the run up to each row; the run that opens the stream starts from 0, all others from ROOT."""
    held = 0
    for batch in _numbered(batches):
        keys = []
        for n, digest, first in zip(batch.column("n").to_pylist(), batch.column("digest").to_pylist(), batch.column("first").to_pylist()):
            if n == 1:
                held = 0 if first else 1
            held = (held * BASE + int.from_bytes(digest, "big")) % MODULUS
            keys.append(held.to_bytes(16, "big"))
        yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("n"), pa.array(keys, pa.binary()), batch.column("digest"), batch.column("words"), batch.column("first")],
                                         names=["c", "n", "key", "digest", "words", "first"])


def _carried(placed: DataFrame, chained: bool) -> dict[int, tuple[int, int, int]]:
    """For each range, the conversation that the ranges before it end with: (c, rows, hash). One row per range is collected."""
    key = F.col("key") if chained else F.lit(ROOT)
    ends = placed.groupBy(F.shiftright("mark", PART).alias("part")).agg(F.max(F.struct("mark", "c", "n", key.alias("key"), "first")).alias("x"))
    out, held = {}, None
    for row in sorted(ends.collect(), key=lambda r: r.part):
        out[row.part], x = held, row.x
        n, value = x.n, int.from_bytes(x.key, "big")
        if x.first:  # the whole range is one run
            before = held if held and held[0] == x.c else (x.c, 0, 1)
            value = (before[2] * pow(BASE, n, MODULUS) + value) % MODULUS
            n += before[1]
        held = (x.c, n, value)
    return {part: x for part, x in out.items() if x}


def _joined_up(shared, chained: bool):
    """Numbers and hashes of the rows that open a range, with those of the ranges before; the hash before each row as ``parent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, c = batch.column("n").to_numpy().copy(), batch.column("c").to_numpy()
            part = batch.column("mark").to_numpy() >> PART
            keys = batch.column("key").to_pylist() if chained else None
            for i in np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False)).tolist():
                before = shared.value.get(int(part[i]))
                _, rows, value = before if before and before[0] == c[i] else (None, 0, 1)
                if chained:
                    keys[i] = ((value * pow(BASE, int(n[i]), MODULUS) + int.from_bytes(keys[i], "big")) % MODULUS).to_bytes(16, "big")
                n[i] += rows
            if not chained:
                yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(n), batch.column("digest"), batch.column("words")], names=["c", "n", "digest", "words"])
                continue
            back = pow(BASE, -1, MODULUS)
            parents = [((int.from_bytes(k, "big") - int.from_bytes(d, "big")) * back % MODULUS).to_bytes(16, "big") for k, d in zip(keys, batch.column("digest").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(n), pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), batch.column("words")],
                                             names=["c", "depth", "key", "parent", "words"])

    return run


def _walk(rows: DataFrame, order: list[Column], scratch: Scratch, chained: bool) -> DataFrame:
    """Rows (c, digest, words) numbered, or chained to prefixes, inside each conversation by ``order``."""
    ordered = rows.repartitionByRange("c", *order).sortWithinPartitions("c", *order).select("c", "digest", "words")
    local = "c long, n long, {}digest binary, words long, first boolean".format("key binary, " if chained else "")
    placed = scratch.cut(ordered.mapInArrow(_chained if chained else _numbered, local).withColumn("mark", F.monotonically_increasing_id()), "walked")
    shared = rows.sparkSession.sparkContext.broadcast(_carried(placed, chained))
    out = "c long, depth long, key binary, parent binary, words long" if chained else "c long, n long, digest binary, words long"
    return placed.mapInArrow(_joined_up(shared, chained), out)


class Messages:
    """A priority queue of totals addressed to nodes, deepest and then smallest key first."""

    def __init__(self, spill: int = SPILL) -> None:
        self.spill, self.heap, self.runs, self.heads = spill, [], [], []

    def send(self, depth: int, key: bytes, leaves: int, saved: int) -> None:
        heapq.heappush(self.heap, (-depth, key, leaves, saved))
        if len(self.heap) > self.spill:
            self.heap.sort()
            self.runs.append([0, b"".join(m[1] for m in self.heap), *(array("q", [m[i] for m in self.heap]) for i in (0, 2, 3))])
            self.heap = []
            self._next(len(self.runs) - 1)

    def _next(self, number: int) -> None:
        run = self.runs[number]
        at, keys, depths, leaves, saved = run
        if at == len(depths):
            self.runs[number] = None
            return
        heapq.heappush(self.heads, (depths[at], keys[16 * at:16 * at + 16], leaves[at], saved[at], number))
        run[0] += 1

    def __len__(self) -> int:
        return len(self.heap) + len(self.heads) + sum(len(r[2]) - r[0] for r in self.runs if r)

    def receive(self, depth: int, key: bytes) -> tuple[int, int]:
        """Sum of all messages to a node; those to nodes before it in the order must have been received."""
        leaves = saved = 0
        while self.heap and self.heap[0][:2] == (-depth, key):
            *_, a, b = heapq.heappop(self.heap)
            leaves, saved = leaves + a, saved + b
        while self.heads and self.heads[0][:2] == (-depth, key):
            _, _, a, b, number = heapq.heappop(self.heads)
            leaves, saved = leaves + a, saved + b
            self._next(number)
        return leaves, saved


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtree totals of a stream sorted by shard, depth (deepest first) and key."""
    shard, queue = None, Messages()
    for batch in batches:
        shards, depths, keys, parents, own_leaves, own_saved = (batch.column(c).to_pylist() for c in ("shard", "depth", "key", "parent", "leaves", "saved"))
        leaves, saved = [], []
        for s, depth, key, parent, a, b in zip(shards, depths, keys, parents, own_leaves, own_saved):
            if s != shard:
                if len(queue):
                    raise ValueError("a shard ended with messages that no node received")
                shard = s
            more = queue.receive(depth, key)
            a, b = a + more[0], b + more[1]
            if key != s:  # the shard's root sends across shards instead
                queue.send(depth - 1, parent, a, b)
            leaves.append(a), saved.append(b)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("parent"), pa.array([k == s for k, s in zip(keys, shards)], pa.bool_()),
                                          pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())], names=["key", "parent", "top", "n_leaves", "saved_tokens"])
    if len(queue):
        raise ValueError("a shard ended with messages that no node received")


def _id_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comma-joined ids of each key, in pieces that start with their first id, from a stream sorted by key and id."""
    for batch in batches:
        keys, ids = batch.column("key").to_pylist(), batch.column("c").to_pylist()
        out, i = [], 0
        for j in range(1, len(keys) + 1):
            if j == len(keys) or keys[j] != keys[i] or j - i == PIECE_IDS:
                out.append((keys[i], ids[i], ",".join(map(str, ids[i:j]))))
                i = j
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], names=["key", "c", "ids"])


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None

    def done(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["key", "ends_sha256"])

    for batch in batches:
        rows = []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k != key:
                if key is not None:
                    rows.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield done(rows)
    if key is not None:
        yield done([(key, digest.hexdigest())])


def _shared_turns(c: str) -> Column:
    return F.crc32(F.col(c).cast("string").cast("binary")) % LONGEST


def rebuilt(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns (c, part, n, digest, words) of all rebuilt conversations, and all conversation ids (c), turnless ones too."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), digest.alias("digest"), words.alias("words"))
    placed = scratch.cut(_walk(turns, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], scratch, False), "placed")
    ids = scratch.cut(placed.select("c").distinct(), "ids")
    own = placed.where(F.col("n") > _shared_turns("c")).select("c", F.lit(1).alias("part"), "n", "digest", "words")
    heads = placed.where((F.col("c") % GROUP == 0) & (F.col("n") < LONGEST)).withColumnRenamed("c", "head")
    takers = ids.select("c", (F.col("c") - F.col("c") % GROUP).alias("head"), _shared_turns("c").alias("h")).where("h > 0")
    taken = takers.join(heads, "head").where("n <= h").select("c", F.lit(0).alias("part"), "n", "digest", "words")
    return own.unionByName(taken), ids


def trie(conversations: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per distinct prefix of the rebuilt ``conversations`` (conv_id, turn, role, text): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), then by role and the md5 digest of length of role, ":", role and text; rows that
    agree in all are turns one after the other. Null roles and texts are empty. Rows without a conv_id are left out. A
    conversation takes over as many first turns of conversation c - c % 20 as crc32 of its id modulo 4 says, if there are so
    many. Without conversations there is no node. Other columns are not read.
    """
    spark = conversations.sparkSession
    scratch = scratch or Scratch(spark, "trie")
    turns, ids = rebuilt(conversations, scratch)
    paths = scratch.cut(_walk(turns, [F.col("part"), F.col("n")], scratch, True), "paths")
    all_convs, least = ids.agg(F.count("*"), F.min("c")).first()

    named = paths.groupBy("key").agg(F.min("c").alias("owner"), F.first("depth").alias("depth"), F.first("parent").alias("parent"),
                                     F.first("words").alias("words"), F.count("*").alias("n"))
    top = ids.agg(F.min("c").alias("owner"), F.count("*").alias("n")).where("n > 0").select(
        F.lit(ROOT).alias("key"), "owner", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"), "n")
    nodes = scratch.cut(named.unionByName(top), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(
        F.count("*").alias("n_children"), F.count_if(F.col("n") == 1).alias("tails"))
    nodes = scratch.cut(nodes.join(children, "key", "left").fillna(0, ["n_children", "tails"]), "nodes")

    # every prefix that two conversations share, along every conversation
    shared = nodes.where("n > 1 and depth > 0").select("key", "owner", "n")
    heavy = scratch.cut(shared.where(F.col("n") > max(64, paths.count() // SHARE)).select("key"), "heavy")
    along = scratch.cut(join_unique(paths.select("key", "c", "depth"), shared, "key", None if heavy.isEmpty() else heavy, "inner"), "along")

    totals = _subtrees(nodes.where("n > 1"), along, all_convs or 0, scratch)
    nodes = nodes.join(totals, "key", "left")
    # a parent that only this conversation has is its own; the root has all
    above = along.select(F.col("c").alias("owner"), (F.col("depth") + 1).alias("depth"), F.col("owner").alias("above"))
    parent = F.when(F.col("depth") == 1, F.lit(least)).when(F.col("depth") > 1, F.coalesce("above", "owner"))
    nodes = nodes.join(above, ["owner", "depth"], "left")

    last = paths.groupBy("c").agg(F.max_by("key", "depth").alias("key"))
    ends = ids.join(last, "c", "left").select("c", F.coalesce("key", F.lit(ROOT)).alias("key"))
    lists = ends.repartitionByRange("key", "c").sortWithinPartitions("key", "c").mapInArrow(_id_lists, "key binary, c long, ids string")
    digests = lists.repartition("key").sortWithinPartitions("key", "c").mapInArrow(_id_digests, "key binary, ends_sha256 string")
    out = nodes.join(digests, "key", "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def _subtrees(nodes: DataFrame, along: DataFrame, all_convs: int, scratch: Scratch) -> DataFrame:
    """(key, n_leaves, saved_tokens) of ``nodes`` with two conversations or more, tier by tier."""
    bounds = [FIRST]
    while bounds[-1] < all_convs:
        bounds.append(bounds[-1] * STEP)
    # the highest prefix of each conversation that is small enough for a tier; all of the last tier hang on the root
    tops = [F.min_by("key", F.when(F.col("n") <= b, F.col("depth"))).alias(f"top{t}") for t, b in enumerate(bounds[:-1])]
    roots = along.groupBy(F.col("c").alias("owner")).agg(*tops) if tops else None
    out, messages, below = None, None, 1
    for t, bound in enumerate(bounds):
        some = nodes.where((F.col("n") > below) & (F.col("n") <= bound))
        some = some.join(roots.select("owner", F.col(f"top{t}").alias("shard")), "owner") if t < len(tops) else some.withColumn("shard", F.lit(ROOT))
        leaves = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("tails")).cast("long")
        some = some.select("shard", "depth", "key", "parent", leaves.alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved"))
        if messages is not None:
            some = some.join(messages, "key", "left").select("shard", "depth", "key", "parent", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                                                             (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        stream = some.repartition("shard").sortWithinPartitions("shard", F.col("depth").desc(), "key")
        done = scratch.cut(stream.mapInArrow(_totals, "key binary, parent binary, top boolean, n_leaves long, saved_tokens long"), f"tier{t}")
        sent = done.where("top and parent is not null").select(F.col("parent").alias("key"), "n_leaves", "saved_tokens")
        sent = sent.groupBy("key").agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        messages = sent if messages is None else messages.unionByName(sent).groupBy("key").agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
        rows = done.select("key", "n_leaves", "saved_tokens")
        out, below = rows if out is None else out.unionByName(rows), bound
    return out
