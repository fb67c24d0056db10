import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pressroom.llm import line_index
from pressroom.llm.oracles import ORACLE
from pressroom.llm.queries import QUERIES
from tests.compare import connect, differences


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), max_size=400), st.randoms())
def test_minimal_perfect_hash(keys, random):
    h, g = (np.array([x[i] for x in sorted(keys)], np.uint64) for i in (0, 1))
    n = np.array([random.choice([1, 2, 700]) for _ in keys], np.int64)
    keep = np.arange(len(keys))
    arrays = line_index.Arrays.unpacked(line_index.Arrays.build(h, g, n, keep).packed())
    assert len(arrays.marks) == len(arrays.counts) == len(keys)  # minimal: a place for each key and no other
    counts, keeps = arrays.probe(h, g)
    assert counts.tolist() == np.minimum(n, 255).tolist()
    assert keeps.tolist() == np.where(n > 1, keep, line_index.NO_ID).tolist()
    assert (arrays.probe(h, g ^ np.uint64(1))[0] == 0).all()


def test_equal_keys_are_refused():
    twice = np.array([5, 5], np.uint64)
    with pytest.raises(ValueError):
        line_index.Arrays.build(twice, twice, np.ones(2, np.int64), np.ones(2, np.int64))


def brute(rows, least=10):
    blank = " \t\n\v\f\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = defaultdict(set)
    order = lambda i: line_index.NO_ID if i is None else i
    split = [(i, (t or "").split("\n")) for i, t in rows]
    keyed = lambda x: x.strip(blank).translate(lower)
    for i, lines in split:
        for line in lines:
            holders[keyed(line)].add(order(i))
    out = []
    for i, lines in split:
        gone = [len(keyed(x)) >= least and len(holders[keyed(x)]) > 1 and min(holders[keyed(x)]) != order(i) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, f in zip(lines, gone) if not f)))
    return sorted(out, key=str)


ROWS = [
    (1, None), (2, ""), (3, "short\nshort"), (4, "short\nA line that repeats\nA line that repeats\nown line of four"), (5, " \ta LINE that repeats\r\nown line of five\n"),
    (6, "A line that repeats"), (6, "A line that repeats\nline of six here"), (6, "line of six here"), (None, "line of six here\nnobody's own line"),
    (None, "nobody's own line"), (7, "nobody's own line\nÄÖÜ äöü é"), (8, "ÄÖÜ äöü é\näöü äöü ée\nÄÖÜ äöü éE"), (9, "ÄÖÜ äöü éE\n\n\n"), (10, "x" * 300_000 + "\n" + "very common line " * 3),
    (11, "\n".join(f"numbered line {i % 500}" for i in range(20_000))), (12, "numbered line 7\n" * 9), (12, "numbered line 7\n" * 9), (-3, "numbered line 499\nnumbered line 5000"),
] + [(100 + i, "very common line very common line very common line\nits own line, " + str(i) + "\nSHARED " + str(i % 7) + " shared") for i in range(300)]


@pytest.mark.parametrize("head, shard", [(1 << 16, 1 << 16), (1, 16), (64, 4)])
def test_against_brute_force(spark, monkeypatch, head, shard):
    monkeypatch.setattr(line_index, "HEAD_KEYS", head)
    monkeypatch.setattr(line_index, "SHARD_KEYS", shard)
    docs = spark.createDataFrame([(i, t, "k", 5, "t") for i, t in ROWS], "doc_id long, text string, k string, t int, gone string").repartition(5)
    got = line_index.line_dedup(docs)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_text"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS)


def test_shared_fixture(docs, rows, no_docs):
    got = line_index.line_dedup(docs, least=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute([r[:2] for r in rows], 3)
    assert line_index.line_dedup(no_docs).collect() == []


def test_sql(spark, sf_dir):
    assert differences(spark, connect(sf_dir), sf_dir, QUERIES["op13_line_index"], ORACLE["op13_line_index"]) is None


def test_digest(spark, sf_dir):
    row = QUERIES["op13_line_index"](spark, sf_dir).where("n_lines = n_dropped").first()
    assert row is None or row.kept_sha256 == hashlib.sha256(b"").hexdigest()
