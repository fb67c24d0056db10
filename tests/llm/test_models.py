import bisect
import math
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressroom.llm import gam, hyperdim, ppm
from pressroom.llm.common import read, remainder
from pressroom.llm.queries import QUERIES
from pressroom.runtime import Scratch


def plain_log(counts, context, symbol):
    """One symbol by the textbook: from the longest known context down, excluding what longer ones have seen."""
    total, excluded = 0.0, set()
    while True:
        seen = {s: n for s, n in counts.get(context, {}).items() if s not in excluded}
        if context in counts:
            t, d = sum(seen.values()), len(seen)
            if symbol in seen:
                return total + math.log10((2 * seen[symbol] - 1) / (2 * t))
            if t + d:
                total += math.log10(d / (2 * t))
            excluded |= set(seen)
        if not context:
            return total - math.log10(256 - len(excluded))
        context = context[1:]


def counts_of(texts):
    counts = defaultdict(lambda: defaultdict(int))
    for t in texts:
        s = b"\xff" * ppm.ORDER + b" ".join(t.split()) + b"\xff"
        for i in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER + 1):
                counts[s[i - k:i]][s[i]] += 1
    return counts


def test_ppm_against_the_textbook(docs, rows):
    held = {2, 6, 15, 16}
    got = ppm.score(docs, F.col("doc_id").isin(*held)).collect()
    norm = lambda t: (t or "").encode().lower()
    train = [norm(r[1]) for r in rows if r[0] not in held]
    counts = counts_of(train)
    words = defaultdict(int)
    for t in train:
        for w in [*t.split(), b""]:
            words[w] += 1
    n, v = sum(words.values()), len(words)
    want = []
    for doc_id, text, *_ in rows:
        t = norm(text)
        s = b"\xff" * ppm.ORDER + b" ".join(t.split()) + b"\xff"
        tokens = [*t.split(), b""]
        score = sum(plain_log(counts, s[i - ppm.ORDER:i], s[i]) for i in range(ppm.ORDER, len(s)))
        base = sum(math.log10((words.get(w, 0) + 1) / (n + v + 1)) for w in tokens)
        want.append((doc_id, doc_id in held, len(tokens), sum(w in words for w in tokens), n, base, score))
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, round(r[6], 3))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-4, abs=1e-4)


def test_ppm_sums_to_one(spark):
    """After any context, known or not, the 256 symbols of the production table share a probability of one."""
    texts = [b"abracadabra abra", b"banana band", b"abba"]
    key, n = np.unique(np.concatenate([ppm.grams(*ppm.stream([t]))[0] for t in texts]), return_counts=True)
    contexts = [int.from_bytes(c, "big") for c in (b"\xff\xff\xff\xff\xff", b"abrac", b"zzzba", b"zzzzz", b"banan")]
    trained = dict(zip(key.tolist(), n.tolist()))
    asked = {c << 8 | s for c in contexts for s in range(256)}
    counts = spark.createDataFrame([(g, trained.get(g, 0), 1) for g in sorted(asked | set(trained))], "gram long, n long, seen long")
    logs = {r.gram: r.log for r in ppm.logs_of(counts, Scratch(spark)).collect()}
    assert len(logs) == len(asked | set(trained))
    for c in contexts:
        assert sum(10 ** logs[c << 8 | s] for s in range(256)) == pytest.approx(1, abs=1e-9)


def test_ppm_long_words_are_not_broadcast(spark):
    """Words over HEAD_BYTES meet their counts by the join, however frequent, in text without blanks too."""
    texts = ["x" * 200 + " a a", "X" * 200, "y" * 64 + " " + "x" * 200, "語" * 40, "語" * 40 + " a", "語" * 41]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.score(docs, F.col("doc_id") == 5).collect()}
    words = Counter(w for t in texts[:5] for w in [*t.lower().split(), ""])
    total, distinct = sum(words.values()), len(words)
    for i, t in enumerate(texts):
        tokens = [*t.lower().split(), ""]
        base = sum(math.log10((words[w] + 1) / (total + distinct + 1)) for w in tokens)
        assert got[i].n_known == sum(w in words for w in tokens) and got[i].base_score == pytest.approx(base, rel=1e-9)


def test_ppm_rare_words_and_pruning(docs, monkeypatch):
    """A tiny head and few nodes: the word model stays exact, the trie stays a distribution."""
    whole = {(r.doc_id, round(r.base_score, 6), r.n_known) for r in ppm.score(docs, F.col("doc_id") == 15).collect()}
    monkeypatch.setattr(ppm, "HEAD_WORDS", 3)
    some = ppm.score(docs, F.col("doc_id") == 15, max_nodes=50).collect()
    assert {(r.doc_id, round(r.base_score, 6), r.n_known) for r in some} == whole
    assert all(r.score <= 0 for r in some)


def test_ppm_scores_do_not_depend_on_the_head(docs):
    """Strings outside the head meet the same logs by a join: no node is pruned."""
    held = F.col("doc_id").isin(2, 6, 15, 16)
    key = lambda r: (r.doc_id or 0, r.n_tokens, round(r.score, 3))
    whole, some, none = (sorted(ppm.score(docs, held, **kw).collect(), key=key) for kw in ({}, {"max_nodes": 50}, {"max_nodes": 0}))
    for a, b, c in zip(whole, some, none, strict=True):
        assert a.doc_id == b.doc_id == c.doc_id and b.score == pytest.approx(a.score, rel=1e-9) == c.score


def test_ppm_beats_words_on_held_out_texts(spark, sf_dir):
    rows = QUERIES["op3_ppm_score"](spark, "/root/testdata/sf0.1").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_ppm_empty(no_docs):
    assert ppm.score(no_docs, F.lit(False)).collect() == []


def test_language_of_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    langs = dict(read(spark, sf, "documents", "doc_id", "lang").collect())
    rows = [r for r in QUERIES["op7_hyperdimensional_language"](spark, sf).collect() if r.held_out]
    assert len(rows) > 150 and sum(langs[r.doc_id] == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(docs, rows, no_docs):
    got = hyperdim.identify(docs, F.lit(True)).collect()
    assert len(got) == len(rows)
    und = sorted(str(r.doc_id) for r in got if r.lang_pred == "und")
    assert und == ["1", "2", "3", "8"] and all(r.score == 0 for r in got if r.lang_pred == "und")
    stage = hyperdim.with_language(docs, F.lit(True))
    assert stage.columns == docs.columns and stage.count() == len(rows) - 4
    assert hyperdim.identify(no_docs, F.lit(True)).collect() == []
    assert {r.lang_pred for r in hyperdim.identify(docs, F.lit(False)).collect()} == {"und"}


def test_trigram_counts_do_not_depend_on_the_path(monkeypatch):
    texts = ["Héllo wörld 12 a", "x", "", "żółw żółw", "The theory"]
    (dense,) = hyperdim.trigrams(texts)
    monkeypatch.setattr(hyperdim, "DENSE", 0)
    (sparse,) = hyperdim.trigrams(texts)
    assert all((a == b).all() for a, b in zip(dense, sparse))


def test_quality_of_held_out_texts(spark):
    sf = "/root/testdata/sf0.1"
    labels = dict(read(spark, sf, "labels", "doc_id", "quality").collect())
    rows = [r for r in QUERIES["op10_quality_gam"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(labels[r.doc_id] == r.predicted for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_of_odd_texts(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(9, 1), (14, 0), (13, 1), (1, None), (None, 1), (4, 7)], "doc_id long, label int")
    got = gam.quality(docs, labels, remainder("doc_id", 4) == 2).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = gam.quality(docs, labels.limit(0), F.lit(False)).collect()
    assert {r.score for r in none} == {0.5}
    assert gam.quality(no_docs, labels, F.lit(False)).collect() == []


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x, y, rounds=10, pairs=1)
    assert list(model.pairs) == [(0, 1)]
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_language_stage_rejects_through_the_method(spark):
    """Long texts of unknown languages go, unwanted languages go if asked, and without a learnt language only letterless texts go."""
    rng = np.random.default_rng(3)
    foreign = " ".join("".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 3000, 6)) for _ in range(60))
    english = "the quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree near the quiet river and nobody hears"
    german = "der schnelle braune Fuchs springt über den faulen Hund während sieben weise Eulen von der alten Eiche am stillen Fluss zusehen"
    rows = [(1, english, "en"), (2, german, "de"), (3, foreign, None), (4, "ok", None), (5, "12 34", "en"), (6, None, "en"), (7, "junk " * 5000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    learn = F.col("doc_id").isin(1, 2, 7)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(hyperdim.with_language(docs, learn)) == [1, 2, 4, 7]
    assert 2 in ids(hyperdim.with_language(docs, learn, wanted=["de"]))
    assert 1 not in ids(hyperdim.with_language(docs, learn, wanted=["de"]))
    assert ids(hyperdim.with_language(docs.withColumn("lang", F.lit(None).cast("string")), learn)) == [1, 2, 3, 4, 7]
    assert ids(hyperdim.with_language(docs, F.lit(False))) == [1, 2, 3, 4, 7]


def test_blocks_of_trigrams_change_nothing(monkeypatch):
    ((counts, letters, _),) = hyperdim.trigrams(["one two three four five", "six seven eight nine ten", ""])
    whole = counts @ hyperdim.bound(letters, 256).astype(np.float32)
    monkeypatch.setattr(hyperdim, "BLOCK_TRIGRAMS", 3)
    assert (hyperdim.bundled(counts, letters, 256) == whole).all()


def test_repeated_rows_count_once_in_the_fit(spark):
    rows = [(i, ("good words here " if i % 2 else "BAD!!! 111 ") * (3 + i), i % 2) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int")
    again = docs.unionByName(docs.where("doc_id = 7").crossJoin(spark.range(500)).drop("id"))
    once, many = gam.train(docs, labels, 20), gam.train(again, labels, 20)
    x = np.random.default_rng(1).random((50, len(gam.FEATURES)))
    assert (once.score(x) == many.score(x)).all()


def _plain_vector(text, dimension):
    """A text's bundle by its definition, a trigram at a time."""
    letters = []
    for c in f" {(text or '').lower()} ":
        code = ord(c) if c.isalpha() else 0
        if code or not letters or letters[-1]:
            letters.append(code)
    signs = {c: np.random.default_rng([hyperdim.SEED, c]).integers(0, 2, dimension, np.int8).astype(np.int64) * 2 - 1 for c in set(letters)}
    total = np.zeros(dimension, np.int64)
    for x, y, z in zip(letters, letters[1:], letters[2:]):
        if y:
            total += np.roll(signs[x], 2) * np.roll(signs[y], 1) * signs[z]
    return total


@pytest.mark.parametrize("cells", [1, 1 << 23])
def test_language_against_brute_force(spark, docs, rows, monkeypatch, cells):
    """Whole predictions: profiles, cosine and ties, whatever the runs that texts are counted in."""
    monkeypatch.setattr(hyperdim, "CELLS", cells)
    dimension = 64
    vectors = [_plain_vector(text, dimension) for _, text, *_ in rows]
    sums = {}
    for v, (_, _, lang, *_) in zip(vectors, rows):
        if lang is not None:
            sums[lang] = sums.get(lang, 0) + v
    known = {lang: v / np.linalg.norm(v) for lang, v in sorted(sums.items()) if v.any()}

    def predicted(text, v):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        near = {lang: float(v @ p) / max(np.linalg.norm(v), 1e-9) for lang, p in known.items()}
        best = max(near, key=near.get)
        return best, round(min(max(near[best], 0), 1), 4)

    key = lambda r: (str(r[0]), r[1], r[2])
    want = sorted(((r[0], *predicted(r[1], v)) for r, v in zip(rows, vectors)), key=key)
    got = sorted(((r.doc_id, r.lang_pred, round(r.score, 4)) for r in hyperdim.identify(docs, F.lit(True), dimension).collect()), key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(abs(a[2] - b[2]) < 2e-4 for a, b in zip(got, want))


def test_counts_of_scripts_with_many_letters_stay_small():
    """256 short texts that share hardly a trigram: one matrix of their counts would take half a gigabyte."""
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 650))) for _ in range(256)]
    tracemalloc.start()
    widths = [counts.shape for counts, _, _ in hyperdim.trigrams(texts)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for n, _ in widths) == 256 and all(n * w <= hyperdim.CELLS for n, w in widths) and peak < 150e6


def _plain_features(text):
    """The features by their definition, with Python's own strings."""
    data = text.encode()
    if not data:
        return [0.0] * len(gam.FEATURES)
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", data) if w]
    low = [w.lower() for w in words]
    lines = data.split(b"\n")[:-1] if data.endswith(b"\n") else data.split(b"\n")
    is_letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    count = lambda chars: sum(c in chars for c in data)
    upper, pairs, n = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", list(zip(low, low[1:])), max(1, len(words))
    return [
        math.log1p(len(data)), math.log1p(len(words)), sum(map(len, words)) / n, count(upper) / max(1, sum(map(is_letter, data))), count(b"0123456789") / len(data),
        count(b"#$%&*+<=>@[\\]^_`{}~") / len(data), count(b"!?") / n, sum(c >= 128 for c in data) / len(data), len(set(low)) / n, max(Counter(low).values(), default=0) / n,
        sum(a == b for a, b in pairs) / n, 1 - len(set(pairs)) / max(1, len(pairs)), 1 - len(set(lines)) / len(lines), len(words) / len(lines),
        sum(not any(map(is_letter, w)) for w in words) / n, sum(w[0] in upper for w in words) / n, count(b".;:") / n, count(b"|/") / n,
    ]


def test_quality_against_brute_force(spark, docs, rows):
    """Scores of all texts from the learnt tables, looked up one by one; the tables have pairs and are not flat."""
    rng = np.random.default_rng(2)
    made = [(i, " ".join(rng.choice(["Alpha", "beta", "42", "x!", "gamma.", "a|b", "beta"], int(rng.integers(3, 60)))) + "\nend" * int(rng.integers(0, 4)), int(i % 3 > 0)) for i in range(400)]
    made = [(i, t + " WOW!!! " * (9 if not y and i % 2 else 1), y) for i, t, y in made]
    corpus = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string").unionByName(docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 1000))
    labels = spark.createDataFrame([(i, y) for i, _, y in made], "doc_id long, label int")
    model = gam.train(corpus, labels)
    assert model.pairs and any(t.any() for t in model.tables)

    def scored(text):
        x = _plain_features(text or "")
        total = model.base + sum(t[bisect.bisect_right(e.tolist(), v)] for t, e, v in zip(model.tables, model.edges, x))
        total += sum(t[bisect.bisect_right(model.coarse[a].tolist(), x[a]), bisect.bisect_right(model.coarse[b].tolist(), x[b])] for (a, b), t in model.pairs.items())
        return 1 / (1 + math.exp(-min(max(total, -30), 30)))

    want = sorted([scored(t) for _, t, _ in made] + [scored(r[1]) for r in rows])
    got = sorted(r.score for r in gam.quality(corpus, labels, F.lit(False)).collect())
    assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("seed", range(5))
def test_tree_takes_the_best_cut(seed):
    """Of all first cuts the tree takes one with the largest gain, then likewise on each side."""
    rng = np.random.default_rng(seed)
    g, h, n = rng.normal(0, 5, 9), rng.random(9) * 10, rng.integers(5, 40, 9)
    score = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)

    def grow(a, b, depth):
        cuts = [(score(a, c) + score(c, b), -c) for c in range(a + 1, b) if n[a:c].sum() >= gam.LEAST and n[c:b].sum() >= gam.LEAST]
        if not depth or not cuts or max(cuts)[0] <= score(a, b):
            return [g[a:b].sum() / (h[a:b].sum() + 1)] * (b - a)
        cut = -max(cuts)[1]
        return grow(a, cut, depth - 1) + grow(cut, b, depth - 1)

    assert np.allclose(gam._tree(g, h, n), grow(0, 9, 2))
