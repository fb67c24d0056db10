"""Near-duplicate components by a chosen-path similarity join.

1. One pass makes each text's shingle set, its digest, and SKETCH minwise tokens.
   Texts with equal sets become one document with the smallest id.
2. TREES independent trees: the root of each branches the documents by one selected minwise
   token; in a node with more than LEAF documents those close to its first document are tied to
   it, and the others branch again by two more tokens that the node selects, up to DEPTH times. Documents of Jaccard similarity s share a root branch with
   probability s in each tree, so at 0.8 and ten trees one pair in ten million is missed.
3. Leaves are compared exhaustively on their sketches, in arrays, never as emitted pairs: what
   leaves a leaf is one link per document to the smallest of its candidates. Nodes that are still
   large at the last level consist of near copies and count as candidates of each other.
4. In components of candidates above BLOCK documents or bytes, every document is first checked on the full sets against
   one candidate, its smallest: a tree, so its traffic is two sets a document, and a family of near copies is connected at once.
5. Components of candidates that are not or not yet connected bring their full sets together. Every pair of
   different parts that the sketch does not rule out and that is not already connected is checked there.
   Above BLOCK documents or bytes they are a grid of block pairs, so no task holds more than two blocks; documents of the
   largest part meet those of the others only, never each other.
6. Components of the confirmed links are the result.

Nothing is capped: the bounds (LEAF, BLOCK) only decide how the work is split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import components
from ..runtime import Scratch
from . import common

WIDTH = 5
SIMILARITY = 80  # per cent
SKETCH = 64
TREES = 10
LEAF = 256
DEPTH = 3
SURE = 35  # equal minwise tokens of 64; at similarity 0.8 fewer come up about twice in a million
BEHIND = 40  # similarity 0.62 to a node's first document: its near duplicates have 0.42 or more,
TIED = 18  # and are tied to it from 0.28 on
BLOCK_DOCS = 500
BLOCK_BYTES = 24 << 20
CHILDREN = 1000  # documents that one copy of their common candidate's set is compared with

_A = common.mixed(np.arange(101, 101 + SKETCH, dtype=np.uint64)) | np.uint64(1)
_B = common.mixed(np.arange(501, 501 + SKETCH, dtype=np.uint64))


def sets_of(data: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    starts, ends, doc = common.words(data, at)
    marks = common.span_hashes(common.LOWER[data], starts, ends)
    got, of = common.shingles(marks, doc, width, len(at) - 1)
    borders = np.searchsorted(of, np.arange(len(at)))
    return [np.unique(got[i:j]) for i, j in zip(borders, borders[1:])]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SKETCH minwise tokens (uint32) of each set; an empty set has all ones."""
    out = np.full((len(sets), SKETCH), 0xFFFFFFFF, np.uint32)
    some = [k for k, s in enumerate(sets) if len(s)]
    if some:
        all_ = np.concatenate([sets[k] for k in some])
        first = np.concatenate([[0], np.cumsum([len(sets[k]) for k in some])[:-1]])
        for i in range(SKETCH):
            out[some, i] = np.minimum.reduceat(((all_ * _A[i] + _B[i]) >> np.uint64(32)).astype(np.uint32), first)
    return out


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = common.flat(batch.column("text"))
            for i, j in common.pieces(at):
                sets = sets_of(data[at[i]:at[j]], at[i:j + 1] - at[i], width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                     pa.array([x.tobytes() for x in sketches(sets)], pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "sketch"],
                )

    return run


def token(sketch, place):
    """The minwise token (4 bytes) at a place of the sketch."""
    return F.substring(sketch, place * 4 + 1, 4)


def equal_tokens(a: str, b: str):
    """How many of the SKETCH minwise tokens two sketches share."""
    out = F.lit(0)
    for k in range(SKETCH):
        out = out + (token(F.col(a), F.lit(k)) == token(F.col(b), F.lit(k))).cast("int")
    return out


def smallest_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component label (smallest row) of rows 0..n-1 under links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, least_rows: int) -> Iterator[pa.Table]:
    """Runs of whole groups of a stream that is sorted by ``key``, of about ``least_rows`` rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        if held and size >= least_rows and held[-1].column(key)[-1].as_py() != values[0]:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        at = 0
        while size + batch.num_rows - at >= least_rows:
            want = max(at, at + least_rows - size - 1)
            after = np.flatnonzero(values[want + 1:] != values[want:-1]) if want + 1 < len(values) else []
            if not len(after):
                break
            cut = want + 1 + int(after[0])
            held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches(held)
            held, size, at = [], 0, cut
        if at < batch.num_rows:
            held.append(batch.slice(at))
            size += batch.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare all rows of a node (sorted stream of node, id, n, sketch) by their sketches."""
    for table in _whole_groups(batches, "node", 20_000):
        node = table.column("node").to_numpy()
        ids, sizes = table.column("id").to_numpy(), table.column("n").to_numpy()
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(-1, SKETCH)
        left, right = [], []
        row = np.arange(len(node))
        step = 1
        while True:
            row = row[row + step < len(node)]
            row = row[node[row] == node[row + step]]
            if not len(row):
                break
            near = row[np.minimum(sizes[row], sizes[row + step]) * 100 >= np.maximum(sizes[row], sizes[row + step]) * SIMILARITY]
            for k in range(0, len(near), 50_000):
                part = near[k:k + 50_000]
                same = (sketch[part] == sketch[part + step]).sum(1) >= SURE
                left.append(part[same])
                right.append(part[same] + step)
            step += 1
        if not left:
            continue
        label = smallest_of(len(node), np.concatenate(left), np.concatenate(right))
        own = np.flatnonzero(label != np.arange(len(node)))
        pairs = np.unique(np.stack([ids[own], ids[label[own]]], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def candidates(sets: DataFrame, scratch: Scratch, trees: int = TREES) -> DataFrame:
    """Links (a, b) whose connected components hold every likely pair of ``sets`` (id, n, sketch)."""
    first = F.explode(F.array(*[F.xxhash64(F.lit(t), token(F.col("sketch"), F.lit(t * (SKETCH // trees)))) for t in range(trees)]))
    rows = sets.select(first.alias("node"), "id")
    leaves, links = [], []
    for depth in range(DEPTH + 1):
        rows = scratch.cut(rows, "nodes")
        sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("id").alias("low")).where("size > 1")
        rows = scratch.cut(rows.join(sizes, "node"), "sized")
        leaves.append(rows.where(F.col("size") <= LEAF).select("node", "id"))
        large = rows.where(F.col("size") > LEAF)
        if depth == DEPTH:
            # near copies of each other after so many equal tokens
            links.append(large.where("id != low").select(F.col("id").alias("a"), F.col("low").alias("b")))
            break
        if large.isEmpty():
            break
        # Members close to the node's first document stand behind it: by the triangle inequality of the Jaccard
        # distance, whoever is a near duplicate of one of them comes near the first document as well and is tied to it.
        seen = large.select("node", "id", "low").join(sets, "id")
        first = seen.where("id = low").select("node", F.col("sketch").alias("lead"))
        seen = scratch.cut(seen.join(first, "node").withColumn("equal", equal_tokens("sketch", "lead")).drop("lead"), "led")
        links.append(seen.where((F.col("equal") >= TIED) & (F.col("id") != F.col("low"))).select(F.col("id").alias("a"), F.col("low").alias("b")))
        # every other member branches by the two tokens the node selects
        places = [F.pmod(F.xxhash64("node", F.lit(k)), F.lit(SKETCH)) for k in range(2)]
        children = F.explode(F.array(*[F.xxhash64("node", p, token(F.col("sketch"), p.cast("int"))) for p in places]))
        rows = seen.where(F.col("equal") < BEHIND).select(children.alias("node"), "id")
    every = leaves[0]
    for more in leaves[1:]:
        every = every.unionByName(more)
    stream = every.join(sets, "id").repartition("node").sortWithinPartitions("node")
    links.append(stream.select("node", "id", "n", "sketch").mapInArrow(_leaves, "a long, b long"))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _full_sets(shared, width: int):
    """(id, shingles) of rows whose id hits the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("mark").to_numpy(zero_copy_only=False).view(np.uint64)
            some = np.flatnonzero(common.hits(marks, shared.value))
            if not len(some):
                continue
            batch = batch.take(pa.array(some))
            data, at = common.flat(batch.column("text"))
            for i, j in common.pieces(at):
                sets = sets_of(data[at[i]:at[j]], at[i:j + 1] - at[i], width)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    return run


def _confirm(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spanning links of confirmed pairs in each cell (sorted stream of cell, side, id, part, sketch, shingles)."""
        for table in _whole_groups(batches, "cell", 1):
            cells = table.column("cell").to_numpy()
            borders = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            ids, side, parts_of = table.column("id").to_pylist(), table.column("side").to_numpy(), table.column("part").to_numpy()
            blobs = table.column("shingles").combine_chunks()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(-1, SKETCH)
            out_a, out_b = [], []
            for lo, hi in zip(borders, borders[1:]):
                parts = [np.frombuffer(blobs[k].as_buffer(), np.uint64) for k in range(lo, hi)]
                size = np.array([len(p) for p in parts])
                own, mine = sketch[lo:hi], side[lo:hi]
                cross = mine.any() and not mine.all()  # a cell of two blocks: only pairs across
                root = np.unique(parts_of[lo:hi], return_inverse=True)[1]  # what is connected already
                for i in range(hi - lo - 1):
                    rest = np.arange(i + 1, hi - lo)
                    rest = rest[root[rest] != root[i]]
                    if cross:
                        rest = rest[mine[rest] != mine[i]]
                    rest = rest[np.minimum(size[rest], size[i]) * 100 >= np.maximum(size[rest], size[i]) * similarity]
                    rest = rest[(own[rest] == own[i]).sum(1) >= SURE]
                    for j in rest.tolist():
                        if root[i] == root[j]:
                            continue
                        both = size[i] + size[j] - len(np.unique(np.concatenate([parts[i], parts[j]])))
                        if 100 * both >= similarity * (size[i] + size[j] - both):
                            out_a.append(ids[lo + i])
                            out_b.append(ids[lo + j])
                            root[root == root[j]] = root[i]
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def _similar(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    if 100 * min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 100 * both >= similarity * (len(a) + len(b) - both)


def _against_first(similarity: int):
    """Confirmed links of documents with the candidate of their cell (sorted stream of cell, side, id, shingles; the candidate first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, first, own = None, None, []
        for batch in batches:
            out_a, out_b = [], []
            blobs = batch.column("shingles")
            for k, (c, side, i) in enumerate(zip(batch.column("cell").to_pylist(), batch.column("side").to_pylist(), batch.column("id").to_pylist())):
                if c != cell:
                    cell, first, own = c, None, []
                shingles = np.frombuffer(blobs[k].as_buffer(), np.uint64)
                if side == 0:
                    first = i
                    own.append(shingles.copy())
                elif any(_similar(shingles, x, similarity) for x in own):
                    out_a.append(i)
                    out_b.append(first)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def confirmed(docs: DataFrame, sets: DataFrame, links: DataFrame, groups: DataFrame, scratch: Scratch, width: int, similarity: int) -> DataFrame:
    """Links (a, b) confirmed on full sets that span all true links inside the candidate ``groups`` (node, component) of ``links`` (a, b)."""
    counted = groups.join(sets.select(F.col("id").alias("node"), "n"), "node").groupBy("component").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    is_large = (F.col("docs") > BLOCK_DOCS) | (F.col("shingles") * 8 > BLOCK_BYTES)
    members = groups.join(counted.select("component", is_large.alias("large")), "component").join(sets.withColumnRenamed("id", "node"), "node")
    members = scratch.cut(members.select(F.col("node").alias("id"), "component", "large", "n", "sketch"), "members")
    shared = docs.sparkSession.sparkContext.broadcast(common.bitmap(members.select(F.xxhash64("id").alias("mark"))))
    texts = docs.select("doc_id", F.xxhash64("doc_id").alias("mark"), "text").where("doc_id is not null")
    full = texts.mapInArrow(_full_sets(shared, width), "id long, shingles binary")
    full = scratch.cut(full.join(members.select("id").distinct(), "id", "left_semi"), "full")

    # one candidate for each document; the set of a candidate of many goes out once for every CHILDREN of them
    tree = links.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("first")).where("id != first").groupBy("id").agg(F.min("first").alias("first"))
    tree = scratch.cut(tree.join(members.where("large").select("id").distinct(), "id", "left_semi"), "tree")
    salts = tree.groupBy("first").agg(F.ceil(F.count("*") / CHILDREN).cast("int").alias("salts"))
    below = full.join(tree.join(salts, "first"), "id")
    cell = F.xxhash64("first", "salt")
    below = below.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).select(cell.alias("cell"), F.lit(1).alias("side"), "id", "shingles")
    above = full.join(salts, full["id"] == salts["first"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    above = above.select(cell.alias("cell"), F.lit(0).alias("side"), "id", "shingles")
    stream = above.unionByName(below).repartition("cell").sortWithinPartitions("cell", "side")
    sure = scratch.cut(stream.mapInArrow(_against_first(similarity), "a long, b long"), "sure")

    # what is still in several parts
    parts = components(sure, scratch)
    placed = members.join(parts.withColumnRenamed("node", "id").withColumnRenamed("component", "part"), "id", "left").withColumn("part", F.coalesce("part", "id"))
    sizes = scratch.cut(placed.groupBy("component", "part").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")), "parts")
    largest = sizes.groupBy("component").agg(F.max(F.struct("docs", "part")).alias("x"), F.count("*").alias("k")).where("k > 1")
    largest = largest.select("component", F.when(F.col("x.docs") > BLOCK_DOCS, F.col("x.part")).alias("major"))
    is_major = F.coalesce(F.col("part") == F.col("major"), F.lit(False))
    open_ = sizes.join(largest, "component").withColumn("is_major", is_major).groupBy("component").agg(
        F.max("major").alias("major"), *[F.sum(F.when(F.col("is_major") == own, F.col(c))).alias(f"{c}_{own}".lower()) for c in ("docs", "shingles") for own in (True, False)])

    def blocks(own: str):
        found = F.greatest(F.ceil(F.col(f"docs_{own}") / BLOCK_DOCS), F.ceil(F.col(f"shingles_{own}") * 8 / BLOCK_BYTES))
        return F.coalesce(found, F.lit(0)).cast("int")

    open_ = open_.select("component", "major", blocks("true").alias("majors"), blocks("false").alias("minors"))
    some = full.join(placed.join(open_, "component").select("id", "component", "part", "sketch", "major", "majors", "minors"), "id")
    own = F.when(is_major, F.pmod(F.xxhash64("id"), F.greatest("majors", F.lit(1)))).otherwise(F.col("majors") + F.pmod(F.xxhash64("id"), F.greatest("minors", F.lit(1)))).cast("int")
    meets = F.sequence(F.when(is_major, F.col("majors")).otherwise(F.lit(0)), F.col("majors") + F.col("minors") - 1)
    spread = some.withColumn("block", own).withColumn("other", F.explode(meets))
    cell = F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other"))
    rows = spread.select(cell.alias("cell"), (F.col("block") > F.col("other")).alias("side"), "id", "part", "sketch", "shingles")
    # more partitions than cores: a partition is read group by group, so its size does not matter
    rest = rows.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(_confirm(similarity), "a long, b long")
    return sure.unionByName(rest)


def near_components(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY, trees: int = TREES, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z lower-cased; links have 100 * intersection >= similarity * union.
    Null and empty texts have an empty set and are linked with nothing. A null doc_id has component null, is kept, and is
    linked with nothing. Rows that repeat a doc_id are one document whose links are those of all its texts.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near")
    rows = docs.select("doc_id", "text")
    marked = scratch.cut(rows.mapInArrow(_sketch(width), "doc_id long, n_shingles long, digest binary, sketch binary"), "sketches")
    some = marked.where("n_shingles > 0 and doc_id is not null")
    sets = some.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("x"), F.count("*").alias("copies"))
    sets = scratch.cut(sets.select("digest", F.col("x.doc_id").alias("id"), F.col("x.n_shingles").alias("n"), "x.sketch", "copies"), "sets")
    narrow = sets.select("id", "n", "sketch")
    likely = scratch.cut(candidates(narrow, scratch, trees), "likely")
    groups = scratch.cut(components(likely, scratch), "groups")
    links = confirmed(rows, narrow, likely, groups, scratch, width, similarity)
    copies = some.select("digest", "doc_id").join(sets.where("copies > 1").select("digest", "id"), "digest").select(
        F.col("doc_id").alias("a"), F.col("id").alias("b"))
    found = scratch.cut(components(links.unionByName(copies), scratch), "components")
    out = marked.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    label = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", label.alias("component_id"), F.col("doc_id").eqNullSafe(label).alias("kept"))


def near_dedup(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY, scratch: Scratch | None = None) -> DataFrame:
    """Rows of ``docs`` with one document of each near-duplicate component left; all columns stay."""
    scratch = scratch or Scratch(docs.sparkSession, "near")
    gone = scratch.cut(near_components(docs, width, similarity, scratch=scratch).where("not kept").select("doc_id").distinct(), "gone")
    return common.without(docs, gone, "doc_id")
