"""Python tasks hold the words of one piece, not of a whole Arrow batch."""

from collections import Counter

import numpy as np
import pyarrow as pa

from pressroom.operators import batches as A
from pressroom.operators.embed import _hash_words, hashed_words
from pressroom.operators.keyword import _runs


def _rows(n, size):
    rng = np.random.default_rng(3)
    return [[f"w{x}" for x in rng.integers(0, 500, size)] for _ in range(n)]


def test_pieces_hold_whole_rows_and_few_words():
    rows = [["a"] * k for k in (3, 0, 4, 9, 1, 0, 2)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["words"])
    parts = [p.column("words").to_pylist() for p in A.word_pieces(batch, "words", 5)]
    assert sum(parts, []) == rows
    assert all(len(p) == 1 or sum(len(r or []) for r in p) <= 5 for p in parts) and len(parts) == 4
    assert not [*A.word_pieces(batch.slice(0, 0), "words")]


def test_postings_leave_piece_by_piece():
    rows = [r[:40] + [None] + r[40:60] + [None] + r[60:] for r in _rows(600, 1000)]
    n = len(rows)
    whole = pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int64()), pa.array([1000] * n, pa.int32()), pa.array([40] * n, pa.int32()), pa.array([61] * n, pa.int32()), pa.array(rows)],
        names=["id", "d", "gap_1", "gap_2", "words"])
    out = [*_runs(iter([whole]))]
    assert max(sum(len(p) for p in b.column("places").to_pylist()) for b in out) <= A.MOST_WORDS
    found = {(r["id"], r["token"]): r["places"] for b in out for r in b.to_pylist()}
    assert sum(b.num_rows for b in out) == len(found)
    for i in (0, 299, n - 1):
        assert {t: len(p) for (d, t), p in found.items() if d == i} == Counter(w for w in rows[i] if w is not None)
        assert all(rows[i][p] == t for (d, t), places in found.items() if d == i for p in places)


def test_vectors_leave_piece_by_piece():
    rows = [*_rows(600, 1000), []]
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.list_(pa.string()))], names=["id", "__words"])
    out = [*_hash_words(8, "embedding")(iter([whole]))]
    assert max(b.num_rows for b in out) * 1000 <= A.MOST_WORDS + 1000
    assert [i for b in out for i in b.column("id").to_pylist()] == [*range(len(rows))]
    vectors = np.array([v for b in out for v in b.column("embedding").to_pylist()])
    some = [0, 299, 599, 600]
    assert np.allclose(vectors[some], hashed_words(8)()([" ".join(rows[i]) for i in some]), atol=1e-6)
