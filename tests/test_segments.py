"""The stored index against one built anew over what should be left."""

import re

import pytest
from hypothesis import given, settings, strategies as st

from pressroom.errors import ConfigurationError
from pressroom.operators import keyword as K
from pressroom.operators.segments import KeywordIndex
from pressroom.runtime import Scratch

ARTICLES = "id long, title string, summary string, full_text string"


def story(i):
    common = "river " * (1 + i % 5)
    rare = "zebra" if i % 97 == 3 else "stone"
    return (i, f"Day {i % 11} at the {rare}", f"{common} mill of the old town {i % 3}", None if i % 4 else "of the mill, off-the-record " * (i % 7))


ROWS = [story(i) for i in range(1, 601)] + [(700, None, None, None), (701, "", "", "")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, ARTICLES)


@pytest.fixture(scope="module")
def kept(spark):
    changed = [(i, t if i % 14 else f"{t} renewed zebra", s, f) for i, t, s, f in ROWS if i % 7 or not i % 14]
    return spark.createDataFrame(changed, ARTICLES)


@pytest.fixture(scope="module")
def store(spark, rows, kept, tmp_path_factory):
    index = KeywordIndex.create(spark, str(tmp_path_factory.mktemp("index")), buckets=8, window=50)
    assert index.add("a", rows.where("id < 200")) and index.add("b", rows.where("id between 200 and 399")) and index.add("c", rows.where("id >= 400"))
    assert not index.add("a", rows.where("id < 10"))
    index.remove(rows.where("id % 7 = 0").select("id"))
    index.remove(rows.where("id % 21 = 0").select("id").union(spark.range(9000, 9003)))  # again, and unknown ones
    index.add("fix", kept.where("id % 14 = 0"))
    return index


QUESTIONS = ["river mill", "off-the-record", "of-the mi*", "day renewed", "nothing here"]


def ranks(index, text, **more):
    terms = K.parse_terms(index.store.spark if hasattr(index, "store") else index.rows.sparkSession, text)
    found = K.score(index, terms, **more)
    return sorted((r.id, round(r["rank"], 9)) for r in found.collect())


@pytest.mark.parametrize("text", QUESTIONS)
def test_ranks_of_one_full_build(spark, store, kept, text):
    full = K.build_index(kept, Scratch(spark))
    assert ranks(store.open(), text) == ranks(full, text)
    assert ranks(store.open(), text, columns=["title"]) == ranks(full, text, columns=["title"])


def test_counts(spark, store, kept):
    full = K.build_index(kept, Scratch(spark))
    assert (store.open().articles, store.open().words) == (full.articles, full.words)


@pytest.mark.parametrize("text, any_word, k", [
    ("river mill", False, 5), ("river zebra", False, 1), ("river zebra", True, 5), ("stone of the", False, 1000), ("nothing river", True, 3), ("nothing river", False, 3)])
def test_best_is_the_top_of_all(store, text, any_word, k):
    terms = K.parse_terms(store.spark, text)
    full = K.score(store.open(), () if any_word else terms, terms if any_word else ())
    scores = {r.id: round(r["rank"], 9) for r in full.collect()} if full is not None else {}
    got = [(r.id, round(r["rank"], 9)) for r in store.open().best(text, k, any_word).rows.collect()]
    assert all(scores[i] == rank for i, rank in got) and len(dict(got)) == len(got)
    assert [rank for _, rank in got] == sorted(scores.values())[:k]


def test_blocks_that_cannot_win_are_not_read(store):
    got = store.open().best("river zebra", 3)  # a word of every article and one of a few
    assert 0 < got.read < got.blocks


def test_lookup_opens_the_folders_of_its_words(store):
    now = store.open()
    plan = now.blocks([K.Term(("zebra",))])._jdf.queryExecution().toString()
    wanted = re.findall(r"PartitionFilters: \[[^\]]*bucket#\d+ = (\d+)", plan)
    assert wanted and int(wanted[-1]) == store.bucket("zebra")
    assert "DataFilters: [isnotnull(token" in plan or "PushedFilters: [IsNotNull(token)" in plan
    plan = now.blocks([K.Term(("zeb",), True)])._jdf.queryExecution().toString()  # the prefix is spelled out
    assert re.search(r"bucket#\d+ = " + str(store.bucket("zebra")), plan)


def test_prefix_with_too_many_words_is_still_right(store, monkeypatch):
    want = ranks(store.open(), "r*")
    monkeypatch.setattr("pressroom.operators.segments.MOST_WORDS", 0)
    assert ranks(store.open(), "r*") == want


def test_dictionary_is_sorted_and_counts(spark, store):
    words = {r.token: r.n for r in store.open().dictionary().collect()}
    assert words["zebra"] == sum(1 for i, *_ in ROWS if i % 97 == 3) + sum(1 for i, *_ in ROWS if i % 14 == 0)
    part = [r.token for r in spark.read.parquet(f"{store.root}/words/segment=a").coalesce(1).collect()]
    assert part == sorted(part)


def test_layout_is_fixed(spark, store):
    with pytest.raises(ConfigurationError):
        KeywordIndex.create(spark, store.root, buckets=9, window=50)


def test_compaction_changes_no_rank(spark, rows, kept, tmp_path):
    index = KeywordIndex.create(spark, str(tmp_path / "index"), buckets=4, window=64)
    index.add("a", rows.where("id < 300"))
    index.add("b", rows.where("id >= 300"))
    index.remove(rows.where("id % 7 = 0").select("id"))
    index.add("fix", kept.where("id % 14 = 0"))
    before = [ranks(index.open(), q) for q in ("river mill", "of-the mi*")]
    assert index.compact("ab", ["a", "b"]) and not index.compact("ab")
    assert [s.segment for s in index.segments()] == ["fix", "ab"] and index.open().removed is None
    assert [ranks(index.open(), q) for q in ("river mill", "of-the mi*")] == before


def test_empty_index(spark, tmp_path):
    index = KeywordIndex.create(spark, str(tmp_path / "index"))
    assert index.open().best("river").rows.collect() == [] and ranks(index.open(), "river") == []
    index.add("none", spark.createDataFrame([], ARTICLES))
    assert (index.open().articles, index.open().words) == (0, 0)


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 50), st.integers(1, 200), st.integers(1, 50), st.integers(1, 200), st.floats(1, 500))
def test_bound_holds_whatever_the_average(f, d, more, longer, average):
    """The largest count and the smallest length bound every article of a block."""
    def part(f, d):
        return f * (K.K1 + 1) / (f + K.K1 * (1 - K.B + K.B * d / average))
    assert part(f + more, d) >= part(f, d) >= part(f, d + longer)


def test_index_follows_the_corpus(spark, rows, tmp_path):
    from pressroom.operators.keyword import keyword_search
    from pressroom.schema import ARTICLES as STORED
    from pressroom.sources.corpus import Corpus

    corpus = Corpus.create(spark, str(tmp_path / "corpus"))
    names = [c.strip().split(" ")[0] for c in STORED.split(",")]

    def batch(some):
        held = spark.createDataFrame([], STORED).unionByName(some, allowMissingColumns=True)
        return {"articles": held.select(*names)}

    corpus.publish("one", batch(rows.where("id < 40")))
    first = corpus.keyword_index()
    corpus.publish("two", batch(rows.where("id between 40 and 90")))
    corpus.remove_articles(rows.where("id in (3, 5, 50)").select("id"))
    now = corpus.keyword_index()
    assert [s.segment for s in now.segments] == ["one", "two"] and (first.articles, now.articles) == (39, 87)
    full = K.build_index(corpus.read("articles"), Scratch(spark))
    assert ranks(now, "river mill") == ranks(full, "river mill") and len(ranks(now, "zebra")) == 0
    hits = keyword_search(now, corpus.read("articles"), "river mill", limit=4).collect()
    assert [h.id for h in hits] == [i for _, i in sorted((r, i) for i, r in ranks(full, "river mill"))[:4]]
    assert [s.no for s in corpus.keyword_index().segments] == [1, 2]  # nothing to do
