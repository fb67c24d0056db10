"""Turning texts into unit vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..errors import EmbeddingMismatch
from .batches import word_pieces

Encoder = Callable[[list[str]], "np.ndarray | Sequence[Sequence[float]]"]

_WORD = re.compile(r"\w+")
_MOST_CODES = 200_000  # words whose codes a worker keeps: some 40 MB
_MODELS: dict[str, Encoder] = {}  # one per Python worker, filled on first use


def hashed_words(dim: int) -> Callable[[], Encoder]:
    """Loader of a model that needs no weights: signed feature hashing of a text's words to a unit vector.

    A word's MD5 gives its place (first eight digits) and its sign (the ninth).
    A text without words has the zero vector.
    """

    def load() -> Encoder:
        held: dict[str, tuple[int, float]] = {}

        def code(word: str) -> tuple[int, float]:
            if (known := held.get(word)) is None:
                if len(held) >= _MOST_CODES:
                    held.clear()
                digest = hashlib.md5(word.encode()).hexdigest()
                known = held[word] = int(digest[:8], 16) % dim, 1.0 if digest[8] < "8" else -1.0
            return known

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for row, text in zip(out, texts):
                for word in _WORD.findall(text.lower()):
                    place, sign = code(word)
                    row[place] += sign
            return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)

        return encode

    return load


def _hash_words(dim: int, out: str):
    """Vectors of word lists: a piece's distinct words are looked up once, their occurrences are added up as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, int]] = {}

        def code_of(word: str) -> tuple[int, int]:
            if (known := held.get(word)) is None:
                if len(held) >= _MOST_CODES:
                    held.clear()
                digest = hashlib.md5(word.encode()).hexdigest()
                known = held[word] = int(digest[:8], 16) % dim, 1 if digest[8] < "8" else -1
            return known

        for whole in batches:
            for batch in word_pieces(whole, "__words"):
                lists = batch.column("__words")
                row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                coded = lists.flatten().dictionary_encode()
                place, sign = np.array([code_of(w) for w in coded.dictionary.to_pylist()], np.int64).reshape(-1, 2).T
                code = coded.indices.to_numpy()
                sums = np.bincount(row * dim + place[code], sign[code], len(lists) * dim).reshape(-1, dim)
                unit = (sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * dim, pa.int32()), pa.array(unit.ravel()))
                kept = [n for n in batch.schema.names if n != "__words"]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), vectors], names=[*kept, out])

    return run


def word_embed(dim: int) -> Callable[[DataFrame], DataFrame]:
    """The ``embed`` step of an ingest with hashed words; texts are lower-cased and cut into words before they leave the JVM."""

    def embed(df: DataFrame) -> DataFrame:
        found = F.regexp_extract_all(F.lower(F.coalesce("document", F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
        schema = T.StructType(df.schema.fields + [T.StructField("embedding", T.ArrayType(T.FloatType()))])
        return df.withColumn("__words", found).mapInArrow(_hash_words(dim, "embedding"), schema)

    return embed


def embed_query(text: str, dim: int) -> list[float]:
    """One query text, on the driver."""
    return np.asarray(hashed_words(dim)()([text]), dtype="float32")[0].tolist()


def embed_texts(
    df: DataFrame,
    text: str,
    load_model: Callable[[], Encoder],
    model_name: str,
    dim: int,
    out: str = "embedding",
    batch_size: int = 256,
) -> DataFrame:
    """Add the embedding of a text column with any encoder.

    ``load_model`` runs once per Python worker, on its first batch; the
    encoder then gets up to ``batch_size`` whole texts at a time.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            if model_name not in _MODELS:
                _MODELS[model_name] = load_model()
            encode = _MODELS[model_name]
            texts = pdf[text].fillna("").tolist()
            rows: list[np.ndarray] = []
            for at in range(0, len(texts), batch_size):
                block = np.asarray(encode(texts[at:at + batch_size]), dtype="float32")
                if block.ndim != 2 or block.shape[1] != dim:
                    raise EmbeddingMismatch(f"{model_name} gave shape {block.shape}, expected dimension {dim}")
                rows.extend(block)
            yield pdf.assign(**{out: rows})

    return df.mapInPandas(run, schema)
