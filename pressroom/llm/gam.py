"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts and shares of a text's bytes, words and lines. Each feature is cut into
bins at quantiles. Training is boosting that cycles over the features: in each round every
feature gets one shallow tree over its bins, shrunk and added to its lookup table; then the
pairs of features with the largest gain on what is left get tables of their own, from trees with
one cut per axis, cycled in the same way. A score is a sum of table entries and a sigmoid.

Features of all texts are computed in Arrow batches. The fit sees at most SAMPLE labelled rows
(a hash of the id decides which), so the tables are learnt on the driver from a bounded matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

SAMPLE = 40_000
BINS = 32
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 8
COARSE = 8
RATE = 0.1
LEAST = 20.0  # rows in a leaf

FEATURES = ("log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "loud", "other_bytes", "distinct_words", "top_word", "echo", "pairs_again",
            "lines_again", "line_words", "wordless", "capital", "stops", "bars")


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _table("0123456789")
_SYMBOL = _table("#$%&*+<=>@[\\]^_`{}~")
_LOUD = _table("!?")
_STOP = _table(".;:")
_BAR = _table("|/")
_HIGH = np.arange(256) >= 128
_LETTER = _UPPER | _table("abcdefghijklmnopqrstuvwxyz") | _HIGH


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text; shares of nothing are 0."""
    n = len(at) - 1
    size = np.diff(at).astype(np.float64)
    solid = np.maximum(size, 1)

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data])])
        return (sums[at[1:]] - sums[at[:-1]]).astype(np.float64)

    starts, ends, doc = common.words(data, at)
    words = np.bincount(doc, minlength=n).astype(np.float64)
    many = np.maximum(words, 1)
    marks = common.span_hashes(common.LOWER[data], starts, ends)

    def repeats(marks: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct marks of each text, and the count of its most frequent."""
        key = np.sort(common.mixed(marks + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16) | doc.astype(np.uint64) << np.uint64(48))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        of = (key[first] >> np.uint64(48)).astype(np.int64)
        most = np.zeros(n)
        np.maximum.at(most, of, np.diff(np.append(first, len(key))))
        return np.bincount(of, minlength=n).astype(np.float64), most

    distinct, most = repeats(marks, doc)
    same = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
    echo = np.bincount(doc[1:][same & (marks[1:] == marks[:-1])], minlength=n) if len(doc) else np.zeros(n)
    two = marks[1:] * np.uint64(3) + marks[:-1] if len(doc) else marks
    pairs, _ = repeats(two[same], doc[1:][same])
    n_pairs = np.bincount(doc[1:][same], minlength=n) if len(doc) else np.zeros(n)
    breaks = np.flatnonzero(data == 10)
    borders = np.unique(np.concatenate([at, breaks + 1]))
    line_start, line_end = borders[:-1], borders[1:]
    line_doc = np.searchsorted(at, line_start, "right") - 1
    lines = np.maximum(np.bincount(line_doc, minlength=n), 1).astype(np.float64)
    whole = line_end - (data[line_end - 1] == 10) if len(line_start) else line_end
    line_marks, _ = repeats(common.span_hashes(data, line_start, whole), line_doc)
    letters = count(_LETTER)
    has_letter = np.zeros(len(starts), bool)
    if len(starts):
        sums = np.concatenate([[0], np.cumsum(_LETTER[data])])
        has_letter = sums[ends] > sums[starts]
    first = data[starts] if len(starts) else np.zeros(0, np.uint8)
    out = np.stack([
        np.log1p(size), np.log1p(words), (np.bincount(doc, ends - starts, n) if len(doc) else np.zeros(n)) / many, count(_UPPER) / np.maximum(letters, 1), count(_DIGIT) / solid,
        count(_SYMBOL) / solid, count(_LOUD) / many, count(_HIGH) / solid, distinct / many, most / many, echo / many, 1 - pairs / np.maximum(n_pairs, 1),
        1 - line_marks / lines, words / lines, (words - np.bincount(doc[has_letter], minlength=n)) / many, np.bincount(doc[_UPPER[first]], minlength=n) / many,
        count(_STOP) / many, count(_BAR) / many,
    ], 1)
    out[size == 0] = 0
    return out


@dataclass
class Model:
    """Bin edges and lookup tables; ``pairs`` maps two features to a table over their coarse bins."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        for (a, b), table in self.pairs.items():
            total += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _quantiles(x: np.ndarray, parts: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, parts) / parts, method="higher"))


def _leaf(g, h):
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values of a shallow regression tree over ordered bins: the best cut, then the best cut of each side."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    if not depth or len(g) < 2:
        return out
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = left_g ** 2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1)
    gain[(left_n < LEAST) | (n.sum() - left_n < LEAST)] = -1
    cut = int(gain.argmax()) + 1
    if gain[cut - 1] <= g.sum() ** 2 / (h.sum() + 1):
        return out
    return np.concatenate([_tree(g[:cut], h[:cut], n[:cut], depth - 1), _tree(g[cut:], h[cut:], n[cut:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Best tree with one cut on each axis of a grid of bins: its gain and its values."""
    best, values = 0.0, np.zeros_like(g)
    cg, ch, cn = (np.cumsum(np.cumsum(x, 0), 1) for x in (g, h, n))
    rows, cols = g.shape
    for i in range(rows - 1):
        for j in range(cols - 1):
            def part(c):
                a, top, side, all_ = c[i, j], c[i, -1], c[-1, j], c[-1, -1]
                return np.array([a, top - a, side - a, all_ - top - side + a])
            pg, ph, pn = part(cg), part(ch), part(cn)
            gain = float((np.where(pn >= LEAST, pg ** 2 / (ph + 1), 0)).sum())
            if gain > best:
                v = np.where(pn >= LEAST, _leaf(pg, ph), 0)
                best, values = gain, np.zeros_like(g)
                values[:i + 1, :j + 1], values[:i + 1, j + 1:], values[i + 1:, :j + 1], values[i + 1:, j + 1:] = v
    return best, values


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS, pair_rounds: int = PAIR_ROUNDS) -> Model:
    """Cyclic boosting of one-feature tables, then of tables for the pairs with the largest gain."""
    model = Model()
    rate = (y.sum() + 1) / (len(y) + 2)
    model.base = float(np.log(rate / (1 - rate)))
    width = x.shape[1]
    model.edges = [_quantiles(x[:, f], BINS) if len(x) else np.zeros(0) for f in range(width)]
    model.coarse = [_quantiles(x[:, f], COARSE) if len(x) else np.zeros(0) for f in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not len(x):
        return model
    bins = [np.searchsorted(model.edges[f], x[:, f], "right") for f in range(width)]
    total = np.full(len(y), model.base)
    for _ in range(rounds):
        for f in range(width):
            p = 1 / (1 + np.exp(-total))
            m = len(model.tables[f])
            step = RATE * _tree(np.bincount(bins[f], y - p, m), np.bincount(bins[f], p * (1 - p), m), np.bincount(bins[f], minlength=m))
            model.tables[f] += step
            total += step[bins[f]]
    coarse = [np.searchsorted(model.coarse[f], x[:, f], "right") for f in range(width)]

    def grid(a: int, b: int, p: np.ndarray):
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        cell = coarse[a] * shape[1] + coarse[b]
        size = shape[0] * shape[1]
        return cell, shape, *(np.bincount(cell, w, size).reshape(shape) for w in (y - p, p * (1 - p), np.ones(len(y))))

    p = 1 / (1 + np.exp(-total))
    gains = []
    for a in range(width):
        for b in range(a + 1, width):
            _, _, g, h, n = grid(a, b, p)
            gains.append((-_quadrants(g, h, n)[0], a, b))
    chosen = [(a, b) for gain, a, b in sorted(gains)[:pairs] if gain < 0]
    for _ in range(pair_rounds):
        for a, b in chosen:
            cell, shape, g, h, n = grid(a, b, 1 / (1 + np.exp(-total)))
            step = RATE * _quadrants(g, h, n)[1]
            model.pairs[a, b] = model.pairs.get((a, b), np.zeros(shape)) + step
            total += step.ravel()[cell]
    return model


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    data, at = common.flat(batch.column("text"))
    parts = [features(data[at[i]:at[j]], at[i:j + 1] - at[i]) for i, j in common.pieces(at)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _rows(batch)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rows of ``labels`` (doc_id, label 0 or 1; others are left out), chosen by a hash of the id; rows that repeat an id count once."""
    few = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "label")
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "text", F.col("label").cast("int").alias("label"))
    measured = rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_measure, "doc_id long, label int, x array<double>")
    held = measured.groupBy("doc_id", "label").agg(F.min("x").alias("x")).select("label", "x").toArrow()
    label = held.column("label").to_numpy()
    x = held.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(label), len(FEATURES))
    order = np.lexsort((*x.T, label)) if len(x) else np.zeros(0, np.int64)  # the same sums whatever the order of tasks
    return fit(x[order], label[order].astype(np.float64))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(shared.value.score(_rows(batch)))], names=["doc_id", "held_out", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, held_out, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    ``held_out``: a boolean column over doc_id; labels of such ids are not learnt from. Null text counts as empty and has
    all features 0. Without labels every score is one half.
    """
    held_out = F.coalesce(held_out, F.lit(False))
    model = train(docs, labels.where(~held_out), sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(_score(shared), "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
