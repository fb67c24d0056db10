from itertools import combinations

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pressroom.llm import length_buckets as lb


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=12), st.integers(1, 4))
def test_dynamic_programming_is_optimal(lengths, buckets):
    cells, counts = np.unique(lengths, return_counts=True)
    plan = lb.optimal(cells, counts, cells * counts, buckets)

    def padding(ends):
        return sum(min(e for e in ends if e >= x) - x for x in lengths)

    best = min(padding([*c, cells[-1]]) for k in range(buckets) for c in combinations(cells[:-1].tolist(), min(k, len(cells) - 1)))
    assert plan.padding == best == padding(plan.boundaries) and len(plan.boundaries) <= buckets


def test_pack(docs, rows, no_docs):
    got = lb.pack(docs, buckets=3, token_budget=300).collect()
    assert len(got) == len(rows)
    assert sorted(r.n_tokens for r in got) == sorted(len((r[1] or "").encode().split()) + 1 for r in rows)
    batches = {}
    for r in got:
        assert r.boundary >= r.n_tokens and r.padding == r.boundary - r.n_tokens
        batches.setdefault(r.batch_id, []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    for some in batches.values():
        assert len({r.boundary for r in some}) == 1 and sorted(r.slot for r in some) == list(range(len(some)))
        assert len(some) == 1 or len(some) * some[0].boundary <= 300
    assert lb.pack(no_docs).collect() == []


def test_true_lengths_are_boundaries(spark):
    """Texts of one length above 256 tokens need no padding; many lengths get the exact optimum of the plain recurrence."""
    docs = spark.createDataFrame([(i, "w " * 1000) for i in range(10)], "doc_id long, text string")
    assert [(r.boundary, r.padding) for r in lb.pack(docs).collect()] == [(1001, 0)] * 10
    rng = np.random.default_rng(5)
    lengths = np.concatenate([rng.integers(1, 4000, 900), rng.integers(30_000, 90_000, 60)])
    cells, counts = np.unique(lengths, return_counts=True)
    got = lb.optimal(cells, counts, cells * counts, 6)
    c, s, m = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(cells * counts)]), len(cells)
    best = [0, *(cells * c[1:] - s[1:]).tolist()]
    for k in range(2, 7):
        best = [0 if j < k else min(best[i] + int(cells[j - 1] * (c[j] - c[i]) - (s[j] - s[i])) for i in range(k - 1, j)) for j in range(m + 1)]
    assert got.padding == best[m] == sum(int(min(e for e in got.boundaries if e >= x) - x) for x in lengths)
