from itertools import combinations

import numpy as np
import pytest

from pressroom.llm import chosen_path
from pressroom.operators.components import components
from pressroom.runtime import Scratch


def brute(rows, width):
    sets = {}
    for doc_id, text, *_ in rows:
        w = (text or "").encode().lower().split()
        own = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        sets.setdefault(doc_id, []).append(own)
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations([(i, s) for i, own in sets.items() for s in own if i is not None and s], 2):
        both = len(a[1] & b[1])
        if 100 * both >= 80 * (len(a[1]) + len(b[1]) - both):
            x, y = sorted((find(a[0]), find(b[0])))
            label[y] = x
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, own in sets.items() for s in own), key=str)


@pytest.mark.parametrize("width", [4, 5])
def test_against_brute_force(docs, rows, width):
    got = [tuple(r) for r in chosen_path.near_components(docs, width=width).collect()]
    assert sorted(got, key=str) == brute(rows, width)


def test_groups_larger_than_leaf_and_block(spark, monkeypatch):
    """Hundreds of near copies of one text, and of a second one, with small bounds so that every path is taken."""
    monkeypatch.setattr(chosen_path, "LEAF", 8)
    monkeypatch.setattr(chosen_path, "BLOCK_DOCS", 20)
    rng = np.random.default_rng(3)
    base = [[f"w{k}" for k in rng.integers(0, 5000, 120)] for _ in range(3)]
    rows = []
    for i in range(240):
        w = list(base[i % 3])
        for at in rng.integers(0, 120, rng.integers(0, 8)):
            w[at] = f"v{rng.integers(0, 10_000)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in chosen_path.near_components(docs, width=4).collect()]
    assert sorted(got, key=str) == brute(rows, 4)


def test_a_family_of_near_copies_has_linear_traffic(spark, monkeypatch):
    """A thousand near copies of one text are connected through one candidate each; only what that leaves open meets in blocks."""
    monkeypatch.setattr(chosen_path, "BLOCK_DOCS", 20)
    monkeypatch.setattr(chosen_path, "CHILDREN", 50)
    seen = []
    confirm = chosen_path._confirm

    def counted(similarity):
        total = spark.sparkContext.accumulator(0)
        seen.append(total)
        inner = confirm(similarity)

        def run(batches):
            def count(batches):
                for b in batches:
                    total.add(b.num_rows)
                    yield b
            yield from inner(count(batches))
        return run

    monkeypatch.setattr(chosen_path, "_confirm", counted)
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in rng.integers(0, 5000, 150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1000):
        w = list(base)
        w[int(rng.integers(0, 150))] = f"v{i}"
        rows.append((i, " ".join(w)))
    far = list(base)  # some documents near the family but not of it
    for at in range(0, 150, 18):
        far[at] = "other"
    rows += [(2000 + i, " ".join(far[:140 + i])) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in chosen_path.near_components(docs, width=4).collect()]
    assert {r[2] for r in got if r[0] < 1000} == {0} and all(r[2] != 0 for r in got if r[0] >= 2000)
    assert sum(x.value for x in seen) <= 4 * len(rows)


def test_stage(docs):
    kept = {r.doc_id for r in chosen_path.near_dedup(docs).collect()}
    assert {1, 2, 3, None, 4, 9, 11, 14} <= kept and not kept & {5, 10, 12, 13, 17}


def test_empty(no_docs):
    assert chosen_path.near_components(no_docs).collect() == []
    assert chosen_path.near_dedup(no_docs).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 900), (900, 501), (7, 7)], "a long, b long")
    got = dict(components(links, Scratch(spark)).collect())
    assert all(got[i] == 0 for i in range(201)) and got[900] == got[501] == 500
