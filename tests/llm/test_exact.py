import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from pressroom.llm import quotient
from pressroom.llm.oracles import ORACLE
from pressroom.llm.queries import QUERIES
from tests.compare import connect, differences


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 58) - 1), max_size=300), st.lists(st.integers(0, 40), max_size=300))
def test_filters_round_trip_and_merge(a, b):
    parts = [np.unique(np.array(x, np.uint64), return_counts=True) for x in (a, b, a)]
    blobs = [quotient.build_filter(k, c, 58) for k, c in parts]
    for (k, c), blob in zip(parts, blobs):
        got, n = quotient.read_filter(blob, 58)
        assert got.tolist() == k.tolist() and n.tolist() == c.tolist()
    keys, n = quotient.merge_sorted([quotient.read_filter(x, 58) for x in blobs])
    want, counts = np.unique(np.array(a + b + a, np.uint64), return_counts=True)
    assert keys.tolist() == want.tolist() and n.tolist() == counts.tolist()


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").encode().lower()].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_against_brute_force(docs, rows):
    got = [tuple(r) for r in quotient.exact_groups(docs).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_stage_keeps_one_row_of_each_text(docs, rows):
    got = quotient.exact_dedup(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    texts = {(t or "").encode().lower() for _, t, *_ in rows}
    assert len(kept) == len(texts) and {(t or "").encode().lower() for _, t in kept} == texts
    assert (13, [r[1] for r in rows if r[0] == 13][0]) in kept and 9 not in [i for i, _ in kept]


def test_repeated_ids_with_other_texts_lose_no_text(spark):
    rows = [(1, "x"), (1, "y"), (2, "y"), (3, "z"), (3, "Z"), (3, "w"), (4, "w"), (5, "only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((r.doc_id, r.text.lower()) for r in quotient.exact_dedup(docs).collect())
    assert got == [(1, "x"), (2, "y"), (3, "z"), (4, "w"), (5, "only")]


def test_empty(no_docs):
    assert quotient.exact_groups(no_docs).collect() == []
    assert quotient.exact_dedup(no_docs).collect() == []


def test_sql(spark, sf_dir):
    for name in ("op2_arc_to_warc", "op5_quotient_dedup", "op6_url_vocabulary", "op8_length_buckets"):
        assert differences(spark, connect(sf_dir), sf_dir, QUERIES[name], ORACLE[name]) is None, name
