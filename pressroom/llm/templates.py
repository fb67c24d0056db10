"""Benchmark decontamination by templates.

Texts are cut into tokens (runs of letters, or numbers with their points and
commas). Numbers, units after a number, and capitalised words become typed
placeholders; the rest is lower-cased. Windows of WINDOW tokens of this template
meet by hash join, so a question with other numbers, units or names still meets its
benchmark item. A second template keeps capitalised words as words, for copies
whose case was changed. Windows need LEAST_WORDS words that are no placeholder; those with fewer,
but at least one, meet by their very tokens instead, so short arithmetic items are found verbatim.

Of the matches of a document and an item, the slots must be consistent: each value of
the item stands for one value of the document. A document may hold an item more than once, with
other values each time, so this is asked of three kinds of alignments: windows at one distance from their
place in the item, windows that follow each other in the order of the item, and each window's first place in the
document. A document is reported for an item when in one of them enough of the item's windows match and
their slots are consistent; the figures are those of the best one.

Documents are read once. A bitmap of the benchmark's window hashes (fixed 8 MB) lets a
task emit only windows that may match; the exact hash join follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import Scratch
from . import common

WINDOW = 8
LEAST_WORDS = 4
ENOUGH_WINDOWS = 6
CONSISTENT = 0.75

# Units that may follow a number.
UNITS = ("mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres gallon gallons s sec second "
         "seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees mph kmh kb mb gb").split()

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SIGN = np.zeros(256, bool)
SIGNS = np.frombuffer(b"+-*/=<>^%", np.uint8)
_SIGN[SIGNS] = True
# capital letters of all scripts with at most three bytes
_CAPITAL = np.array([chr(c).isupper() or chr(c).istitle() for c in range(0x10000)], bool)
_POINT = np.zeros(256, bool)
_POINT[[44, 46]] = True
NUMBER, UNIT, NAME = (common.mixed(np.array([x], np.uint64))[0] for x in (11, 12, 13))


def _unit_hashes() -> np.ndarray:
    raw = [u.encode() for u in UNITS]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(u) + 1 for u in raw])[:-1]])
    return np.sort(common.span_hashes(data, starts, starts + np.array([len(u) for u in raw])))


UNIT_HASHES = _unit_hashes()


def _capital(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether the character of two or three bytes at each place is a capital letter."""
    b = [data[np.minimum(starts + k, len(data) - 1)].astype(np.int64) for k in range(3)]
    two, three = (b[0] >= 0xC3) & (b[0] < 0xE0), (b[0] >= 0xE0) & (b[0] < 0xF0)
    code = np.where(two, (b[0] & 31) << 6 | b[1] & 63, np.where(three, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, 0))
    return (two | three) & _CAPITAL[code]


def template(data: np.ndarray, at: np.ndarray, signs: bool = False):
    """Of the texts in ``data``: word hash, named-template hash, plain-template hash and document of each token.

    The named template has placeholders for numbers, units and names; the plain one for numbers and units only.
    With ``signs``, signs of operation are tokens of their own, and what comes first is the byte of each sign (0: none).
    """
    n = len(data)
    none = np.zeros(0, np.uint64)
    if not n:
        return (np.zeros(0, np.uint8),) * signs + (none, none, none, np.zeros(0, np.int64))
    digit = _DIGIT[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    inner = np.zeros(n, bool)
    if n > 2:
        inner[1:-1] = _POINT[data[1:-1]] & digit[:-2] & digit[2:] & ~edge[1:-2] & ~edge[2:-1]
    kind = np.where(digit | inner, 1, np.where(_LETTER[data], 2, 0)).astype(np.int8)
    if signs:  # neighbouring signs are two tokens: their kinds alternate
        kind = np.where(_SIGN[data], 3 + (np.arange(n) & 1), kind).astype(np.int8)
    before = np.zeros(n, np.int8)
    before[1:] = kind[:-1]
    starts = np.flatnonzero((kind > 0) & ((kind != before) | edge[:-1]))
    after = np.zeros(n, np.int8)
    after[:-1] = kind[1:]
    ends = np.flatnonzero((kind > 0) & ((kind != after) | edge[1:])) + 1
    doc = np.searchsorted(at, starts, "right") - 1
    low = common.LOWER[data]
    word = common.span_hashes(low, starts, ends)
    number = kind[starts] == 1
    follows = np.zeros(len(starts), bool)
    follows[1:] = number[:-1] & (doc[1:] == doc[:-1])
    spot = np.minimum(np.searchsorted(UNIT_HASHES, word), len(UNIT_HASHES) - 1)
    unit = follows & (UNIT_HASHES[spot] == word)
    first, second = data[starts], data[np.minimum(starts + 1, n - 1)]
    name = ~number & (_UPPER[first] & ~(_UPPER[second] & (ends - starts > 1)) | _capital(data, starts))
    plain = np.where(number, NUMBER, np.where(unit, UNIT, word))
    return (np.where(kind[starts] > 2, first, 0).astype(np.uint8),) * signs + (word, np.where(name & ~unit, NAME, plain), plain, doc)


def windows(codes: np.ndarray, word: np.ndarray, doc: np.ndarray, n_docs: int, width: int, exact: bool = False):
    """Hash and first token of each window of ``width`` tokens with enough words that are no placeholder.

    ``exact``: of those with fewer, hashed by their tokens.
    """
    total = len(codes)
    if total < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(total - width + 1, np.uint64)
    hashed = word if exact else codes
    for k in range(width):
        out = out * common._MIX[33] + hashed[k:total - width + 1 + k] * common._MIX[k]
    literal = np.concatenate([[0], np.cumsum(codes == word)])
    literal = literal[width:] - literal[:-width]
    enough = literal >= min(LEAST_WORDS, (width + 1) // 2)
    if exact:
        enough = ~enough
    spot = np.flatnonzero(enough & (doc[width - 1:] == doc[:total - width + 1]))
    return common.mixed(out[spot] + np.uint64(width + (WINDOW + 1) * exact)), spot


def sums(sign: np.ndarray, codes: np.ndarray, word: np.ndarray, doc: np.ndarray, width: int):
    """Hash and first token of each window of ``width`` tokens of the stream with signs that has few words but enough words and signs."""
    total = len(codes)
    if total < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def held(test: np.ndarray) -> np.ndarray:
        so_far = np.concatenate([[0], np.cumsum(test)])
        return so_far[width:] - so_far[:-width]

    operations = held(sign > 0)
    spot = np.flatnonzero((operations > 0) & (doc[width - 1:] == doc[:total - width + 1]))
    if not len(spot):
        return np.zeros(0, np.uint64), spot
    words = held((codes == word) & (sign == 0))[spot]
    kinds = sum((held(sign == x)[spot] > 0).astype(np.int64) for x in SIGNS)
    least = min(LEAST_WORDS, (width + 1) // 2)
    spot = spot[(words < least) & (words + operations[spot] >= least) & ((words > 0) | (kinds > 1))]
    out = np.zeros(len(spot), np.uint64)
    for k in range(width):
        out = out * common._MIX[33] + codes[spot + k] * common._MIX[k]
    return common.mixed(out + np.uint64(width + 2 * (WINDOW + 1))), spot


def _emit(batches: Iterator[pa.RecordBatch], key: str, widths: list[int], held: np.ndarray | None, whole: bool, signs: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows (key, row, mark, pos, home, exact, slots, n): windows of the batches; ``held``: only those that hit this bitmap.

    ``home``: the first place of an equal window in the text. ``whole``: each text's own width, which is WINDOW or its number of tokens if smaller. ``signs``: windows of the stream with signs too.
    """
    for batch in batches:
        data, at = common.flat(batch.column("text"))
        ids, numbers = batch.column(key), batch.column("row")
        for i, j in common.pieces(at):
            part, borders = data[at[i]:at[j]], at[i:j + 1] - at[i]
            for stream in range(1 + signs):
                sign, word, named, plain, doc = template(part, borders, True) if stream else (None, *template(part, borders))
                first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=j - i))])
                rows: list[tuple[np.ndarray, np.ndarray, int, bool]] = []
                for width in widths:
                    if stream:
                        choices = [(sums(sign, plain, word, doc, width), False)]
                    else:
                        choices = [(windows(codes, word, doc, j - i, width, exact), exact) for codes, exact in ((named, False), (plain, False), (plain, True))]
                    for (marks, spot), exact in choices:
                        if whole and len(spot):
                            fits = np.minimum(WINDOW, first[doc[spot] + 1] - first[doc[spot]]) == width
                            marks, spot = marks[fits], spot[fits]
                        if held is not None and len(marks):
                            keep = common.hits(marks, held)
                            marks, spot = marks[keep], spot[keep]
                        if len(marks):
                            rows.append((marks, spot, width, exact))
                if rows:
                    yield _window_rows(rows, stream, word, plain if stream else named, doc, first, i, ids, numbers, key)


SECOND = 1 << 30  # added to places in the stream with signs, so that no place of the first is meant


def _window_rows(rows: list, stream: int, word: np.ndarray, named: np.ndarray, doc: np.ndarray, first: np.ndarray, i: int, ids: pa.Array, numbers: pa.Array, key: str) -> pa.RecordBatch:
    marks = np.concatenate([r[0] for r in rows])
    spot = np.concatenate([r[1] for r in rows])
    width, exact = (np.concatenate([np.full(len(r[0]), r[c]) for r in rows]) for c in (2, 3))
    # each hash once at every place
    order = np.lexsort((spot, marks, doc[spot]))
    marks, spot, width, exact = marks[order], spot[order], width[order], exact[order]
    first_one = np.ones(len(marks), bool)
    first_one[1:] = (marks[1:] != marks[:-1]) | (doc[spot[1:]] != doc[spot[:-1]])
    home = spot[np.maximum.accumulate(np.where(first_one, np.arange(len(marks)), 0))]
    new = first_one.copy()
    new[1:] |= spot[1:] != spot[:-1]
    marks, spot, width, exact, home = marks[new], spot[new], width[new], exact[new], home[new]
    slots = [[int(x) if named[p + k] != word[p + k] else None for k, x in enumerate(word[p:p + w].view(np.int64).tolist())] for p, w in zip(spot, width)]
    shift = SECOND * stream
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(doc[spot] + i)), numbers.take(pa.array(doc[spot] + i)), pa.array(marks.view(np.int64)),
         pa.array((spot - first[doc[spot]] + shift).astype(np.int32)), pa.array((home - first[doc[spot]] + shift).astype(np.int32)),
         pa.array(exact), pa.array(slots, pa.list_(pa.int64())), pa.array((first[doc[spot] + 1] - first[doc[spot]]).astype(np.int64))],
        names=[key, "row", "mark", "pos", "home", "exact", "slots", "n"],
    )


def leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Pairs of document (doc_id, text) and benchmark item (item_id, text) that share the item's template.

    Columns: doc_id, item_id, matched_windows, item_windows, coverage, slot_consistency, verbatim (all slot
    values equal). Enough windows: ENOUGH_WINDOWS or half of the item's, if that is less, of all or of
    those of its template. Windows of numbers and units alone match verbatim. Null or empty
    texts on either side match nothing; items with fewer than WINDOW tokens are one window. Rows
    that repeat a doc_id (or a null one) count as one document.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "leaks")
    schema = "{} long, row long, mark long, pos int, home int, exact boolean, slots array<long>, n long"
    numbered = F.monotonically_increasing_id().alias("row")
    items = scratch.cut(benchmark.select("item_id", numbered, "text").mapInArrow(
        lambda b: _emit(b, "item_id", list(range(1, WINDOW + 1)), None, True), schema.format("item_id")), "items")
    shared = spark.sparkContext.broadcast(common.bitmap(items))
    widths = sorted(r[0] for r in items.select(F.size("slots")).distinct().collect())  # at most WINDOW values
    signs = not items.where(F.col("pos") >= SECOND).isEmpty()  # without an arithmetic item the second stream cannot match
    found = docs.select("doc_id", numbered, "text").mapInArrow(lambda b: _emit(b, "doc_id", widths, shared.value, False, signs), schema.format("doc_id"))
    sizes = items.groupBy("item_id").agg(F.countDistinct("home").alias("item_windows"), F.countDistinct(F.when(~F.col("exact"), F.col("home"))).alias("item_templates"))
    found = scratch.cut(found, "found").withColumnsRenamed({"pos": "doc_pos", "home": "doc_home", "slots": "doc_slots"}).drop("n", "exact")
    pairs = found.join(items.drop("n", "row"), "mark").select(
        "doc_id", "row", "item_id", "pos", "home", "exact", "doc_pos", (F.col("pos") == F.col("home")).alias("main"), (F.col("doc_pos") == F.col("doc_home")).alias("first"),
        F.expr("filter(arrays_zip(slots, doc_slots), x -> x.slots is not null and x.doc_slots is not null)").alias("slots"),
    )
    # a run goes on while later places are later in the item
    run = Window.partitionBy("row", "item_id", "main", F.col("pos") >= SECOND).orderBy("doc_pos", "pos")
    pairs = pairs.withColumn("back", (F.col("pos") < F.lag("pos").over(run)).cast("int"))
    pairs = pairs.withColumn("run", F.sum(F.coalesce("back", F.lit(0))).over(run.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))

    def among(kind: int, row, at) -> Column:
        return F.struct(F.lit(kind).alias("kind"), row.alias("row"), at.alias("at"))

    # rows that repeat a doc_id count as one document: the first places are those of all its rows
    alignments = F.array_compact(F.array(
        F.when(F.col("main") & F.col("first"), among(0, F.lit(0).cast("long"), F.lit(0))), among(1, F.col("row"), F.col("doc_pos") - F.col("pos")),
        F.when(F.col("main"), among(2, F.col("row"), F.col("run")))))
    seen = pairs.select("doc_id", "item_id", "home", "exact", "slots", F.explode(alignments).alias("alignment")).groupBy("doc_id", "item_id", "alignment").agg(
        F.size(F.collect_set("home")).cast("long").alias("matched_windows"), F.size(F.collect_set(F.when(~F.col("exact"), F.col("home")))).alias("matched_templates"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    seen = seen.join(F.broadcast(sizes) if sizes.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS else sizes, "item_id")
    seen = seen.withColumn("values", F.expr("size(array_distinct(slots.slots))")).withColumn(
        "slot_consistency", F.when(F.col("values") == 0, 1.0).otherwise(F.col("values") / F.size("slots")))

    def enough(windows: str) -> Column:
        return F.greatest(F.lit(1), F.least(F.lit(ENOUGH_WINDOWS), F.ceil(F.col(windows) / 2)))

    # a copy with other values has none of the windows that meet by their tokens: those of the template are enough
    matched = (F.col("matched_windows") >= enough("item_windows")) | (F.col("matched_templates") >= enough("item_templates"))
    seen = seen.where(matched & (F.col("slot_consistency") >= CONSISTENT))
    best = F.max(F.struct("matched_windows", "slot_consistency", F.expr("forall(slots, x -> x.slots = x.doc_slots)").alias("verbatim"), "item_windows")).alias("best")
    return seen.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.matched_windows", "best.item_windows", (F.col("best.matched_windows") / F.col("best.item_windows")).alias("coverage"),
        "best.slot_consistency", "best.verbatim",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Rows of ``docs`` that leak no benchmark item; all columns stay. Rows with a null doc_id stay."""
    scratch = scratch or Scratch(docs.sparkSession, "leaks")
    gone = scratch.cut(leaks(docs, benchmark, scratch).where("doc_id is not null").select("doc_id").distinct(), "gone")
    return common.without(docs, gone, "doc_id")
