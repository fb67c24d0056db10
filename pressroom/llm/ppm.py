"""Language-model scoring by prediction by partial matching.

The model is a trie of byte contexts of up to ORDER bytes over the lower-cased words of a
text, joined by one blank and closed by an end symbol. Escape estimation is method D: a
context seen T times with d different successors gives a successor (2c - 1) / 2T and
escape d / 2T. After an escape the symbols of the longer context are excluded from the
shorter one. In a trained trie the excluded set depends on the longer context alone, so
the probability of a symbol is a number of its (ORDER + 1)-byte string.

Counts cover all texts: tasks count (ORDER + 1)-byte strings (in training texts, and in all) and
words, Spark adds them. The trie is a written table of all nodes, none is pruned. Each distinct
string gets its exact log by joins on (order, gram): one that was trained on from its node, any
other by the escapes from its longest known context down. The MAX_NODES strings most frequent in
all texts are broadcast (16 MB for any corpus) and looked up in the task; the others, counted per
document, meet their logs by a join.

The word model (base score) is exact for all words: the HEAD_WORDS most frequent of up to HEAD_BYTES
bytes are looked up in the task, all others, long ones included, meet their counts by a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import Scratch
from . import common

ORDER = 5
MAX_NODES = 1 << 20
HEAD_WORDS = 1 << 18
HEAD_BYTES = 64  # of a word in the head: 16 MB of words at most
FLUSH_WORDS = 300_000
FLUSH_GRAMS = 800_000
END = 0xFF  # no byte of UTF-8
U8 = np.uint64(8)


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with ORDER start marks before and an end mark after each; the borders."""
    parts = [b"\xff" * ORDER + b" ".join(t.split()) + b"\xff" for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def grams(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ORDER + 1)-byte strings that end at each coded symbol, as numbers, and their text."""
    n = max(len(data) - ORDER, 0)
    key = np.zeros(n, np.uint64)
    for k in range(ORDER + 1):
        key <<= U8
        key |= data[k:n + k]
    inside = np.ones(n, bool)  # by the place of the first byte: those that reach over a border do not count
    for k in range(1, ORDER + 1):
        inside[borders[1:-1] - k] = False
    sizes = np.diff(borders) - ORDER
    return key[inside], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def _norms(batch: pa.RecordBatch, limit: int = common.PIECE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Lower-cased texts of runs [i, j) of the batch's rows."""
    data, at = common.flat(batch.column("text"))
    whole = memoryview(data)
    for i, j in common.pieces(at, limit):
        yield i, j, [bytes(whole[at[k]:at[k + 1]]).lower() for k in range(i, j)]


COUNT_ROW = pa.schema([("gram", pa.int64()), ("token", pa.binary()), ("n", pa.int64()), ("seen", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of byte strings and of words (the end token is the empty word) of the training rows; ``seen``: of byte strings in all rows."""

    def row(gram, token, n, seen):
        return pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(token, pa.binary()), pa.array(n, pa.int64()), pa.array(seen, pa.int64())], schema=COUNT_ROW)

    def sum_up(held):
        keys, order = np.unique(np.concatenate([k for k, _, _ in held]), return_inverse=True)
        return keys, *(np.bincount(order, np.concatenate([h[c] for h in held])).astype(np.int64) for c in (1, 2))

    def spill(held):
        keys, n, seen = sum_up(held)
        for i in range(0, len(keys), 200_000):
            k = keys[i:i + 200_000]
            yield row(k.view(np.int64), [None] * len(k), n[i:i + 200_000], seen[i:i + 200_000])

    tokens: Counter[bytes] = Counter()
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        apart = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        for i, j, norms in _norms(batch):
            for x, out in zip(norms, apart[i:j]):
                if out:
                    continue
                tokens.update(x.split())
                tokens[b""] += 1
                if len(tokens) > FLUSH_WORDS:
                    yield row([None] * len(tokens), list(tokens), list(tokens.values()), [0] * len(tokens))
                    tokens = Counter()
            key, doc = grams(*stream(norms))
            out = apart[i:j][doc]
            for some, trained in ((key[~out], 1), (key[out], 0)):
                if len(some):
                    keys, n = np.unique(some, return_counts=True)
                    held.append((keys, n * trained, n))
                    size += len(keys)
            if size > 2 * FLUSH_GRAMS:
                held = [sum_up(held)]
                size = len(held[0][0])
                if size > FLUSH_GRAMS:
                    yield from spill(held)
                    held, size = [], 0
    if tokens:
        yield row([None] * len(tokens), list(tokens), list(tokens.values()), [0] * len(tokens))
    if held:
        yield from spill(held)


def floor_of(rows: DataFrame, most: int) -> int:
    """The smallest power of two so that at most ``most`` rows have a count ``n`` of it or more."""
    level = F.length(F.bin("n")) - 1  # counts of 2^level or more
    sizes = {r["level"]: r["rows"] for r in rows.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect()}
    floor, kept = 1 << 62, 0
    for lev in range(62, -1, -1):
        kept += sizes.get(lev, 0)
        if kept > most:
            break
        floor = 1 << lev
    return floor


def _tail(gram: str, bytes_: int) -> Column:
    return F.expr(f"{gram} & {(1 << 8 * bytes_) - 1}L")


def logs_of(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(gram, seen, log): the log10 probability of the last byte of every string counted, under the trie of all nodes.

    ``counts``: gram, n in training texts, seen in all texts; each gram once. No key of a join but those of the shortest
    contexts, which are broadcast, has more than 256 rows on the side of the model.
    """
    tags = F.array(*[F.struct(F.lit(k).alias("k"), _tail("gram", k + 1).alias("gram")) for k in range(ORDER + 1)])
    nodes = scratch.cut(counts.where("n > 0").select(F.explode(tags).alias("x"), "n").groupBy("x.k", "x.gram").agg(F.sum("n").alias("n")), "nodes")
    # of each context: sightings t, successors d, and the sightings x that these successors have in the shorter context
    shorter = nodes.select((F.col("k") + 1).alias("k"), F.col("gram").alias("suffix"), F.col("n").alias("x"))
    suffix = F.expr("case k " + " ".join(f"when {k} then gram & {(1 << 8 * k) - 1}L" for k in range(1, ORDER + 1)) + " end")
    contexts = scratch.cut(
        nodes.withColumn("suffix", suffix).join(shorter, ["k", "suffix"], "left").groupBy("k", F.shiftright("gram", 8).alias("context")).agg(
            F.sum("n").alias("t"), F.count("*").alias("d"), F.coalesce(F.sum("x"), F.lit(0)).alias("x")), "contexts")
    sizes = [{r["k"]: r["count"] for r in t.groupBy("k").count().collect()} for t in (nodes, contexts)]

    def short(table: DataFrame, size: int) -> DataFrame:
        return F.broadcast(table) if size <= common.BROADCAST_ROWS // 4 else table

    longest = contexts.where(F.col("k") == ORDER).select("context", "t")
    trained = counts.where("n > 0").withColumn("context", F.shiftright("gram", 8)).join(longest, "context").select(
        "gram", "seen", (F.log10(2 * F.col("n") - 1) - F.log10(2 * F.col("t"))).alias("log"))
    rows = counts.where("n = 0").select("gram", "seen")
    for k in range(ORDER, -1, -1):
        if k < ORDER:
            level = nodes.where(F.col("k") == k).select(F.col("gram").alias("own"), F.col("n").alias(f"n{k}"))
            rows = rows.withColumn("own", _tail("gram", k + 1)).join(short(level, sizes[0].get(k, 0)), "own", "left").drop("own")
        level = contexts.where(F.col("k") == k).select("context", F.col("t").alias(f"t{k}"), F.col("d").alias(f"d{k}"), F.col("x").alias(f"x{k}"))
        rows = rows.withColumn("context", F.shiftright(_tail("gram", k + 1), 8)).join(short(level, sizes[1].get(k, 0)), "context", "left").drop("context")
    # from the shortest context up: what a string costs from order k down; suffixes of a known context are known
    cost = F.when(F.col("t0").isNull(), -F.log10(F.lit(256.0))).otherwise(-F.log10(F.greatest(256 - F.col("d0"), F.lit(1))))
    for k in range(ORDER + 1):
        t, d = F.col(f"t{k}"), F.col(f"d{k}")
        den, escape = F.log10(2 * t), F.log10(d / (2 * t))
        if k < ORDER:
            rest, others, longer = t - F.col(f"x{k + 1}"), d - F.col(f"d{k + 1}"), F.col(f"t{k + 1}").isNotNull()
            den = F.when(longer, F.log10(F.greatest(2 * rest, F.lit(1)))).otherwise(den)
            escape = F.when(~longer, escape).otherwise(F.when(rest > 0, F.log10(others / (2 * rest))).otherwise(0.0))
        cost = F.when(t.isNull(), 0.0).otherwise(escape) + cost
        if k < ORDER:
            cost = F.when(F.col(f"n{k}").isNotNull(), F.log10(2 * F.col(f"n{k}") - 1) - den).otherwise(cost)
    return scratch.cut(trained.unionByName(rows.select("gram", "seen", cost.alias("log"))), "logs")


class Table:
    """Hash table from 64-bit keys to columns of float64, searched for whole arrays at once.

    Linear probing; all keys are placed in one pass in the order of their home slots.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(1.4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        home = self._home(keys)
        order = np.argsort(home, kind="stable")
        step = np.arange(len(keys))
        place = step + np.maximum.accumulate(home[order] - step) if len(keys) else step
        size = max(1 << bits, int(place[-1]) + 1 if len(keys) else 0) + 1
        self.keys = np.zeros(size, np.uint64)
        self.keys[place] = keys[order]
        self.columns = []
        for column in values.T:
            held = np.zeros(size, np.float64)
            held[place] = column[order]
            self.columns.append(held)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if it is not there."""
        at = self._home(keys)
        got = self.keys[at]
        open_ = np.flatnonzero((got != keys) & (got != 0))
        at[got == 0] = -1
        while len(open_):
            at[open_] += 1
            got = self.keys[at[open_]]
            at[open_[got == 0]] = -1
            open_ = open_[(got != keys[open_]) & (got != 0)]
        return at


SCORE_ROW = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                       ("known_log", pa.float64()), ("score", pa.float64()), ("token", pa.binary()), ("gram", pa.int64()), ("k", pa.int64())])
ONE = np.uint64(1) << np.uint64(56)  # keys of a table are never 0


def _score(shared, head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, log = shared.value
        known_grams, common_words = Table(gram.view(np.uint64) | ONE, log[:, None]), head.value
        for batch in batches:
            uids = batch.column("uid").to_numpy()
            for i, j, norms in _norms(batch, 1 << 19):
                key, doc = grams(*stream(norms))
                at = known_grams.find(key | ONE)
                here = at >= 0
                score = np.bincount(doc[here], known_grams.columns[0][at[here]], j - i).astype(np.float64)
                # the strings outside the head, each once per document
                far_key, far_doc = key[~here].view(np.int64), doc[~here]
                order = np.lexsort((far_key, far_doc))
                far_key, far_doc = far_key[order], far_doc[order]
                new = np.flatnonzero(np.concatenate([[True], (far_key[1:] != far_key[:-1]) | (far_doc[1:] != far_doc[:-1])])) if len(order) else order
                far_n = np.diff(np.append(new, len(order)))
                n, known, logs = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64), np.zeros(j - i)
                rare_uid, rare, rare_n = [], [], []
                for d in range(j - i):
                    words = norms[d].split()
                    n[d] = len(words) + 1
                    seen = Counter(words)
                    seen[b""] = 1
                    times = np.fromiter(seen.values(), np.int64, len(seen))
                    log = np.fromiter(map(common_words.get, seen, repeat(-1.0)), np.float64, len(seen))
                    far = log < 0  # outside the head
                    known[d], logs[d] = times[~far].sum(), times[~far] @ log[~far]
                    if far.any():
                        rare += compress(seen, far)
                        rare_n += times[far].tolist()
                        rare_uid += [int(uids[i + d])] * int(far.sum())
                size, more, grams_more = j - i, len(rare), len(new)
                nulls = [None] * (more + grams_more)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([uids[i:j], np.array(rare_uid, np.int64), uids[i:j][far_doc[new]]])),
                    pa.concat_arrays([batch.column("doc_id").slice(i, size), pa.array(nulls, pa.int64())]),
                    pa.concat_arrays([batch.column("held_out").slice(i, size), pa.array(nulls, pa.bool_())]),
                    pa.concat_arrays([pa.array(n), pa.array(nulls, pa.int64())]), pa.concat_arrays([pa.array(known), pa.array(nulls, pa.int64())]),
                    pa.concat_arrays([pa.array(logs), pa.array(nulls, pa.float64())]), pa.concat_arrays([pa.array(score), pa.array(nulls, pa.float64())]),
                    pa.array([None] * size + rare + [None] * grams_more, pa.binary()),
                    pa.concat_arrays([pa.array([None] * (size + more), pa.int64()), pa.array(far_key[new])]),
                    pa.concat_arrays([pa.array([None] * size + rare_n, pa.int64()), pa.array(far_n.astype(np.int64))]),
                ], schema=SCORE_ROW)

    return run


def score(docs: DataFrame, held_out, max_nodes: int = MAX_NODES, scratch: Scratch | None = None) -> DataFrame:
    """Log10 probabilities of all texts (doc_id, text) under the trie and under the word model.

    ``held_out``: a boolean column; the models learn from rows where it is false or null. Columns: doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score, n_bytes of the coded stream excluded. Null text is empty: one
    end token. ``max_nodes``: the most byte strings to broadcast; scores do not depend on it. Rows with one doc_id are scored apart. Without training rows all symbols are equally likely.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ppm")
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counted = rows.select("text", "held_out").mapInArrow(_count, "gram long, token binary, n long, seen long")
    counts = scratch.cut(counted.groupBy("gram", "token").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")), "counts")
    words = counts.where("token is not null").select("token", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    grams_logs = logs_of(counts.where("gram is not null").select("gram", "n", "seen"), scratch)
    fewest = floor_of(grams_logs.select(F.col("seen").alias("n")), max_nodes)
    shared = spark.sparkContext.broadcast(tuple(common.arrays(grams_logs.where(F.col("seen") >= fewest).select("gram", "log"))))
    brief = F.octet_length("token") <= HEAD_BYTES
    least = floor_of(words.where(brief), HEAD_WORDS)
    in_head = brief & (F.col("n") >= least)
    top = words.where(in_head).toArrow()
    often = top.column("n").to_numpy()
    head = spark.sparkContext.broadcast(dict(zip(top.column("token").to_pylist(), np.log10(often + 1.0).tolist())))
    marked = rows.withColumn("uid", F.monotonically_increasing_id())
    scored = scratch.cut(marked.mapInArrow(
        _score(shared, head), "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, score double, token binary, gram long, k long"), "scored")
    rare = scored.where("token is not null").select("uid", "token", "k").join(words.where(~in_head), "token").select(
        "uid", F.col("k").alias("more"), (F.col("k") * F.log10(F.col("n") + 1)).alias("more_log"), F.lit(0.0).alias("more_score"))
    far = scored.where("gram is not null").select("uid", "gram", "k").join(grams_logs.where(F.col("seen") < fewest), "gram").select(
        "uid", F.lit(0).cast("long").alias("more"), F.lit(0.0).alias("more_log"), (F.col("k") * F.col("log")).alias("more_score"))
    rest = rare.unionByName(far).groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("more", "more_log", "more_score")])
    whole = scored.where("token is null and gram is null").drop("token", "gram", "k").join(rest, "uid", "left")
    base = F.col("known_log") + F.coalesce("more_log", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total["n"] + total["v"] + 1)))
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                        F.lit(total["n"]).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))
