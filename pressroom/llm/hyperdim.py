"""Language identification with hyperdimensional profiles.

Every letter has a random vector of DIMENSION signs, drawn from a generator seeded with its
code point. A trigram binds its letters: the first vector rotated twice, the second once, the
third as it is, multiplied sign by sign. A text is the sum (bundle) of its trigrams, a language
the sum over its training texts; both are compared by cosine. Runs of other characters are one
blank, which is a letter of its own; trigrams have a letter in the middle.

Bundles of languages are integer sums, so they do not depend on how rows are split over tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import common

DIMENSION = 1024
SEED = 20
BLOCK_DOCS = 256
DENSE = 1 << 22
CELLS = 1 << 23  # of a matrix of counts (text x trigram): 64 MB while it is made
BLOCK_TRIGRAMS = 4096  # trigrams whose vectors are held at once: some 20 MB
LEAST_SCORE = 0.08  # cosine below which a text is in none of the known languages
ENOUGH_TRIGRAMS = 100  # a text with fewer different ones is too short or too uniform for its score to speak against it


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


@lru_cache(maxsize=20_000)
def letter(code: int, dimension: int) -> np.ndarray:
    """The three rotations of a letter's vector of signs."""
    v = np.random.default_rng([SEED, code]).integers(0, 2, dimension, np.int8) * 2 - 1
    return np.stack([np.roll(v, 2), np.roll(v, 1), v])


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text and trigram of every occurrence, the letters of each trigram, and whether a text has a letter."""
    parts = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    codes = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    codes = np.where(_letters()[codes], codes, 0)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (of[1:] != of[:-1])
    codes, of = codes[keep], of[keep]
    some = np.zeros(len(texts), bool)
    some[of[codes != 0]] = True
    alphabet = np.flatnonzero(np.bincount(codes, minlength=1))
    a = len(alphabet)
    small = np.zeros(int(alphabet[-1]) + 1 if a else 1, np.int64)
    small[alphabet] = np.arange(a)
    c = small[codes]
    middle = np.flatnonzero(codes[1:-1] != 0) + 1 if len(codes) > 2 else np.zeros(0, np.int64)
    key = (c[middle - 1] * a + c[middle]) * a + c[middle + 1]
    doc = of[middle]
    if a ** 3 <= DENSE:
        there = np.flatnonzero(np.bincount(key, minlength=1))
        place = np.zeros(int(there[-1]) + 1 if len(there) else 1, np.int64)
        place[there] = np.arange(len(there))
        at = place[key]
    else:
        there, at = np.unique(key, return_inverse=True)
    return doc, at, alphabet[np.stack([there // (a * a), there // a % a, there % a])] if len(there) else np.zeros((3, 0), np.int64), some


def trigrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Counts (text x trigram, float32), the letters of each trigram, and whether a text has a letter, for runs of texts in order.

    A run is halved until its counts have at most CELLS cells or it is one text: texts of scripts with many
    letters share few trigrams.
    """
    doc, at, letters, some = _coded(texts)
    width = letters.shape[1]
    if len(texts) > 1 and len(texts) * width > CELLS:
        del doc, at, letters
        half = len(texts) // 2
        yield from trigrams(texts[:half])
        yield from trigrams(texts[half:])
        return
    counts = np.bincount(doc * max(1, width) + at, minlength=len(texts) * width)
    yield counts.astype(np.float32).reshape(len(texts), width), letters, some


def bound(letters: np.ndarray, dimension: int) -> np.ndarray:
    """Vectors (int8 signs) of trigrams given by their letters."""
    codes, at = np.unique(letters, return_inverse=True)
    at = at.reshape(letters.shape)
    if not len(codes):
        return np.zeros((0, dimension), np.int8)
    base = np.stack([letter(int(c), dimension) for c in codes])
    return base[at[0], 0] * base[at[1], 1] * base[at[2], 2]


def bundled(counts: np.ndarray, letters: np.ndarray, dimension: int) -> np.ndarray:
    """Sum of the trigrams' vectors for each row of counts, a block of trigrams at a time."""
    out = np.zeros((len(counts), dimension), np.float32)
    for at in range(0, counts.shape[1], BLOCK_TRIGRAMS):
        part = slice(at, at + BLOCK_TRIGRAMS)
        out += counts[:, part] @ bound(letters[:, part], dimension).astype(np.float32)
    return out


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    column = batch.column("text")
    _, at = common.flat(column)
    for i, j in common.pieces(at, 1 << 19):
        for k in range(i, j, BLOCK_DOCS):
            end = min(j, k + BLOCK_DOCS)
            yield k, end, [t or "" for t in column.slice(k, end - k).to_pylist()]


def _bundle(dimension: int, level: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for i, j, texts in _blocks(batch):
                own, done = np.array(langs[i:j]), 0
                for counts, letters, _ in trigrams(texts):
                    if level:
                        counts = np.minimum(counts, 1)
                    run_langs = own[done:done + len(counts)]
                    done += len(counts)
                    names = np.unique(run_langs)
                    totals = np.stack([counts[run_langs == lang].sum(0, dtype=np.float64) for lang in names])
                    whole = np.zeros((len(names), dimension))
                    for at in range(0, totals.shape[1], BLOCK_TRIGRAMS):
                        part = slice(at, at + BLOCK_TRIGRAMS)
                        whole += totals[:, part] @ bound(letters[:, part], dimension).astype(np.float64)
                    for lang, v in zip(names, np.rint(whole).astype(np.int64)):
                        sums[lang] = sums.get(lang, 0) + v
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * dimension), pa.array(np.arange(dimension, dtype=np.int32)), pa.array(np.broadcast_to(v, dimension))], names=["lang", "at", "sum"])

    return run


def profiles(labelled: DataFrame, dimension: int = DIMENSION, level: bool = False) -> dict[str, np.ndarray]:
    """Prototype of each language of (text, lang) as a unit vector; null languages are left out.

    ``level``: a text counts each of its trigrams once, so a long text of repeats does not make the prototype.
    """
    rows = labelled.where("lang is not null").select("text", "lang").mapInArrow(_bundle(dimension, level), "lang string, at int, sum long")
    held = rows.groupBy("lang", "at").agg(F.sum("sum").alias("sum"))
    sums: dict[str, np.ndarray] = {}
    for lang, at, value in zip(*(c.tolist() for c in common.arrays(held))):  # languages x dimension
        sums.setdefault(lang, np.zeros(dimension))[at] = value
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(sums.items()) if v.any()}


def _predict(shared, dimension: int, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = [*known, "und"]
        matrix = np.stack(list(known.values())).astype(np.float32).T if known else np.zeros((dimension, 0), np.float32)
        for batch in batches:
            best, score, sizes = [], [], []
            for counts, letters, some in (run for _, _, texts in _blocks(batch) for run in trigrams(texts)):
                whole = bundled(counts, letters, dimension)
                length = np.sqrt(np.einsum("ij,ij->i", whole, whole))
                cosine = (whole @ matrix) / np.maximum(length, 1e-9)[:, None]
                at = cosine.argmax(1) if known else np.zeros(len(counts), np.int64)
                top = cosine[np.arange(len(counts)), at] if known else np.zeros(len(counts))
                fine = some & bool(known)
                best += [names[k] if ok else "und" for k, ok in zip(at, fine)]
                sizes += np.count_nonzero(counts, 1).tolist()
                score += np.where(fine, np.clip(top, 0, 1), 0).astype(np.float64).round(6).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in extra), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(sizes, pa.int64())], names=[*extra, "lang_pred", "score", "n_trigrams"])

    return run


def identify(docs: DataFrame, learn, dimension: int = DIMENSION) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, learnt, lang_pred, score (cosine, 0 to 1), n_trigrams (different ones).

    Profiles come from rows where the column ``learn`` is true and lang is not null. Text that is null or has no
    letter is ``und`` with score 0; so is every text if nothing could be learnt. Ties go to the first name.
    """
    learn = F.coalesce(learn, F.lit(False))
    known = profiles(docs.where(learn).select("text", "lang"), dimension)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    rows = docs.select("doc_id", "text", learn.alias("learnt"))
    return rows.mapInArrow(_predict(shared, dimension, ["doc_id", "learnt"]), "doc_id long, learnt boolean, lang_pred string, score double, n_trigrams long")


def _keep(shared, dimension: int, wanted: frozenset[str] | None, least: float):
    predict = _predict(shared, dimension, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not shared.value:  # nothing learnt: only a text without a letter is in no language
                some = [bool(x) for _, _, texts in _blocks(batch) for run in trigrams(texts) for x in run[2]]
                yield batch.filter(pa.array(some, pa.bool_()))
                continue
            for got in predict(iter([batch])):
                near = pc.or_(pc.greater_equal(got.column("score"), least), pc.less(got.column("n_trigrams"), ENOUGH_TRIGRAMS))
                keep = pc.and_(pc.not_equal(got.column("lang_pred"), "und"), near)
                if wanted is not None:
                    keep = pc.and_(keep, pc.is_in(got.column("lang_pred"), pa.array(sorted(wanted), pa.string())))
                yield batch.filter(keep)

    return run


def with_language(docs: DataFrame, learn, wanted: Iterable[str] | None = None, least: float = LEAST_SCORE, dimension: int = DIMENSION) -> DataFrame:
    """Rows of ``docs`` whose predicted language is one of ``wanted`` (None: any) with a score of ``least`` or more; all columns stay.

    Texts with fewer than ENOUGH_TRIGRAMS different trigrams are not rejected by their score. Null texts and those without a letter go. If nothing could be learnt there is no score to judge by: all texts with a letter stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles(docs.where(F.coalesce(learn, F.lit(False))).select("text", "lang"), dimension, level=True))
    return docs.mapInArrow(_keep(shared, dimension, None if wanted is None else frozenset(wanted), least), docs.schema)
