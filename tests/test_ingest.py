"""Feed, deduplication, ledger, crawl log, corpus and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pressroom.config import Settings
from pressroom.errors import EmbeddingMismatch, FeedError
from pressroom.operators import crawl, dedup, vectors
from pressroom.operators.embed import embed_query, embed_texts, hashed_words
from pressroom.operators.numbering import number_rows
from pressroom.operators.skew import heavy_values, join_unique
from pressroom.plans.ingest import ingest_batch, ingest_into
from pressroom.runtime import Scratch
from pressroom.schema import RAW_FEED
from pressroom.sources import feed as feeds
from pressroom.sources.corpus import Corpus, as_json, export
from pressroom.streaming.alert_stream import alert_stream, daily_counts
from pressroom.streaming.commit_stream import AcceptedAlerts
from pressroom.streaming.ingest_stream import ingest_stream, stream_feed
from tests.standins import hash_embedding

AS_OF = "2026-06-20 00:00:00"
SETTINGS = Settings(embed_model="hash", embed_dim=8)


def embed(df):
    return df.withColumn("embedding", hash_embedding(F.col("document"), 8))


def record(ord, title="T", url=None, publisher="P", topic="x", batch="b", date="Tue, 03 Mar 2026 08:15:00 GMT", **more):
    row = {"batch": batch, "method": "get_news", "topic": topic, "ord": ord, "title": title,
           "url": f"https://h/{ord}" if url is None else url, "description": "d", "published date": date,
           "publisher": publisher}
    return {**row, **more}


def raw(spark, tmp_path, records, name="feed"):
    path = tmp_path / name
    path.mkdir()
    (path / "part.json").write_text("\n".join(json.dumps(r) for r in records))
    return feeds.read_feed(spark, str(path))


def greedy(rows, keys=(), urls=()):
    keys, urls, won = set(keys), set(urls), []
    for ord, key, url in rows:
        if key not in keys and url not in urls:
            keys.add(key), urls.add(url), won.append(ord)
    return won


def edges(spark, rows):
    return spark.createDataFrame(rows, "ord long, composite_key string, url_hash string")


# ---- feed ------------------------------------------------------------------------

def test_feed_forms(spark, tmp_path):
    records = [
        record(1, publisher={"title": "Coast Wire", "href": "https://r"}),
        record(2, publisher={"title": "", "href": "https://r"}),
        record(3, publisher="Post"),
        record(4, publisher=None),
        {**record(5), "published date": "", "published_date": "2026-06-16", "country": "GB", "language": ""},
    ]
    rows = {r.ord: r for r in feeds.normalise_feed(raw(spark, tmp_path, records)).collect()}
    assert [rows[i].publisher_name for i in (1, 2, 3, 4)] == ["Coast Wire", "https://r", "Post", None]
    assert rows[1].publisher_href == "https://r" and rows[3].publisher_href is None
    assert rows[5].published_date == "2026-06-16" and rows[5].country == "GB" and rows[5].language == ""
    assert rows[1].country == "US" and rows[1].language == "en" and rows[1].embed_dim == 384


def test_methods_and_validity(spark, tmp_path):
    good = raw(spark, tmp_path, [record(1), record(2, title=""), record(3, url=""), record(4, title=" ")])
    assert good.where(feeds.is_valid()).count() == 2
    for method in ("get_all", None):
        with pytest.raises(FeedError, match="fetch method"):
            ingest_batch(raw(spark, tmp_path, [record(1), record(2, method=method)], f"bad-{method}"), Scratch(spark), AS_OF, SETTINGS)


def test_feeds_without_order(spark, tmp_path):
    """Files in order of name, records in order of line, listed topics first; ids follow that order."""
    folder = tmp_path / "plain"
    folder.mkdir()
    rows = [("b", 3, "late"), ("a", 1, "soon"), ("a", 2, "late"), ("b", 4, "soon")]
    for name in "ab":
        own = [record(None, f"Story {n}", url=f"https://h/{n}", topic=t) for f, n, t in rows if f == name]
        (folder / f"{name}.json").write_text("\n".join(json.dumps({k: v for k, v in r.items() if k != "ord"}) for r in own))
    plain = ingest_batch(feeds.read_feed(spark, str(folder)), Scratch(spark), AS_OF, SETTINGS)
    assert [r.title for r in plain.articles.orderBy("id").collect()] == ["Story 2", "Story 3", "Story 1", "Story 4"]
    first = ingest_batch(feeds.read_feed(spark, str(folder)), Scratch(spark), AS_OF, SETTINGS, topics=("soon", "late"))
    assert [r.title for r in first.articles.orderBy("id").collect()] == ["Story 1", "Story 4", "Story 2", "Story 3"]
    assert first.summary.agg(F.sum("new")).first()[0] == 4


def test_null_and_repeated_order_are_refused(spark, tmp_path):
    for name, ords in (("null", [1, None]), ("twice", [7, 7])):
        with pytest.raises(FeedError, match="ord"):
            ingest_batch(raw(spark, tmp_path, [record(o, f"S{i}", url=f"https://h/{i}") for i, o in enumerate(ords)], name), Scratch(spark), AS_OF, SETTINGS)
    # Past the check, a loop without progress ends with an error.
    with pytest.raises(FeedError):
        dedup.first_accepts(edges(spark, [(None, "a", "x"), (None, "b", "y")]), Scratch(spark)).collect()


# ---- dedup -----------------------------------------------------------------------

def test_greedy_hand_case(spark):
    rows = [(1, "K1", "U1"), (2, "K2", "U1"), (3, "K2", "U2"), (4, "K3", "U2"), (5, "K1", "U9")]
    won = dedup.first_accepts(edges(spark, rows), Scratch(spark))
    assert sorted(r.ord for r in won.collect()) == [1, 3]
    facts = edges(spark, rows).withColumns({
        "title_slug": F.col("composite_key"), "publisher_norm": F.lit("p"), "seen_at": F.lit(AS_OF).cast("timestamp_ntz")})
    log = dedup.sightings(facts, won.withColumn("id", F.col("ord")))
    assert {r.composite_key: r.seen_count for r in dedup.seen_ledger(log).collect()} == {"K1": 2, "K2": 1}


@pytest.mark.parametrize("most", [0, 8, 500_000])
def test_greedy_random(spark, most):
    """Many small independent feeds at once: the sequential pass decides each."""
    rng = random.Random(most + 1)
    rows, want = [], []
    for feed in range(300):
        size = rng.randint(1, 14)
        part = [(feed * 100 + i, f"{feed}k{rng.randint(1, 5)}", f"{feed}u{rng.randint(1, 5)}") for i in range(size)]
        rows += part
        want += greedy(part)
    won = dedup.first_accepts(edges(spark, rows), Scratch(spark), component_rows=most)
    assert sorted(r.ord for r in won.collect()) == want


def test_greedy_with_known_and_heavy_values(spark):
    """A third of all rows share a key, a fifth a URL; some of both are known."""
    rng = random.Random(4)
    rows = []
    for i in range(6000):
        key = "hot" if rng.random() < 0.34 else f"k{rng.randint(1, 1500)}"
        url = "warm" if rng.random() < 0.2 else f"u{rng.randint(1, 1500)}"
        rows.append((i, key, url))
    rows += [(i, "hot2", f"w{i}") for i in range(6000, 7000)]
    known_keys, known_urls = [f"k{i}" for i in range(1, 300)] + ["hot2"], [f"u{i}" for i in range(200)] + ["warm"]
    for keys, urls in (([], []), (known_keys, known_urls)):
        won = dedup.first_accepts(
            edges(spark, rows), Scratch(spark), component_rows=10, floor_rows=500,
            known_keys=spark.createDataFrame([(k,) for k in keys], "composite_key string") if keys else None,
            known_urls=spark.createDataFrame([(u,) for u in urls], "url_hash string") if urls else None,
        )
        assert sorted(r.ord for r in won.collect()) == greedy(rows, keys, urls)


def test_long_chain(spark):
    rows = [(i, f"k{(i + 1) // 2}", f"u{i // 2}") for i in range(10_000)]
    scratch = Scratch(spark)
    won = dedup.first_accepts(edges(spark, rows), scratch)
    assert sorted(r.ord for r in won.collect()) == greedy(rows)
    assert scratch._step < 40  # tables written, with those of the component search


def test_heavy_join_equals_plain_join(spark):
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("string").alias("k"))
    side = spark.createDataFrame([(str(i), i * 10) for i in range(0, 60, 2)], "k string, v int")
    heavy = heavy_values(rows, "k", Scratch(spark), floor_rows=500)
    assert [r.k for r in heavy.collect()] == ["0"]
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = join_unique(rows, side, "k", heavy, how).orderBy("id").collect()
        assert got == rows.join(side, "k", how).orderBy("id").collect()
    assert heavy_values(rows, "k", Scratch(spark)) is None


def test_numbering(spark):
    values = list(range(0, 5000, 7))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(6)
    rows = number_rows(df, ["v"], Scratch(spark), start=11).collect()
    assert {r.v: r.id for r in rows} == {v: 11 + i for i, v in enumerate(sorted(values))}


def test_empty_slug_option(spark, tmp_path):
    records = [record(1, title="新闻一"), record(2, title="新闻二")]
    data = raw(spark, tmp_path, records)
    kept = ingest_batch(data, Scratch(spark), AS_OF, SETTINGS).summary.first()
    assert (kept["new"], kept["skipped"]) == (1, 1)
    apart = ingest_batch(data, Scratch(spark), AS_OF, Settings(empty_slug="url")).summary.first()
    assert (apart["new"], apart["skipped"]) == (2, 0)


# ---- ingest and corpus -------------------------------------------------------------

def test_ingest_cases(spark, tmp_path):
    corpus = Corpus.create(spark, str(tmp_path / "corpus"))
    first = [
        record(1, "Harbour bridge opens early", publisher={"title": "Coast Wire", "href": "https://r"}),
        record(2, "Harbour bridge opens early", publisher="North Post"),
        record(3, "Harbour bridge: opens early!", publisher="Coast Wire", topic="y"),
        record(4, "Other", url="https://H/1/?utm_source=a#f", topic="y"),
        record(5, "", topic="y"), record(6, "bad port", url="https://h:99999/", topic="y"),
    ]
    summary = {r.topic: r for r in ingest_into(corpus, "b1", raw(spark, tmp_path, first), AS_OF, embed, SETTINGS).collect()}
    assert (summary["x"].fetched, summary["x"].new, summary["x"].skipped) == (2, 2, 0)
    assert (summary["y"].fetched, summary["y"].new, summary["y"].skipped, summary["y"].status) == (4, 0, 2, "success")
    stored = corpus.read("articles").orderBy("id").collect()
    assert [(r.id, r.title, r.publisher_name) for r in stored] == [
        (1, "Harbour bridge opens early", "Coast Wire"), (2, "Harbour bridge opens early", "North Post")]
    assert str(stored[0].published_at) == "2026-03-03 08:15:00" and stored[0].embed_dim == 8
    assert [len(r.embedding) for r in corpus.read("vectors").collect()] == [8, 8]

    # The same batch again changes nothing; the same records in a new batch are all known.
    assert ingest_into(corpus, "b1", raw(spark, tmp_path, first, "f2"), AS_OF, embed, SETTINGS) is None
    again = ingest_into(corpus, "b2", raw(spark, tmp_path, first[:3], "f3"), AS_OF, embed, SETTINGS).collect()
    assert sorted((r.fetched, r.new, r.skipped) for r in again) == [(1, 0, 1), (2, 0, 2)]
    third = ingest_into(corpus, "b3", raw(spark, tmp_path, [record(9, "New")], "f4"), AS_OF, embed, SETTINGS).first()
    assert third["new"] == 1 and corpus.read("articles").agg(F.max("id")).first()[0] == 3
    ledger = dedup.seen_ledger(corpus.read("sightings"), corpus.read("articles"))
    assert {(r.publisher_norm, r.title_slug): (r.seen_count, r.article_id) for r in ledger.collect()} == {
        ("coast wire", "harbour-bridge-opens-early"): (4, 1), ("north post", "harbour-bridge-opens-early"): (2, 2), ("p", "new"): (1, 3)}
    gone = dedup.seen_ledger(corpus.read("sightings"), corpus.read("articles").where("id <> 1"))
    assert sorted((r.article_id or 0) for r in gone.collect()) == [0, 2, 3]
    assert corpus.runs().count() == 5 and {r.status for r in corpus.runs().collect()} == {"success"}
    assert all(r.duration_seconds > 0 for r in corpus.runs().collect())


def test_stopped_and_unannounced_runs(spark, tmp_path):
    corpus = Corpus.create(spark, str(tmp_path / "corpus"))
    records = [record(i, f"Story {i}", topic=t) for i, t in enumerate(["fine", "slow", "slow", "broken", "silent"])]
    header = spark.createDataFrame(
        [("b", "fine", "get_news", False, None), ("b", "slow", "get_news", True, "429"), ("b", "broken", "get_news", False, "boom"), ("b", "none", "get_news", False, None)],
        "batch string, topic string, method string, rate_limited boolean, error string",
    ).withColumns({"started_at": F.lit(AS_OF).cast("timestamp_ntz"), "duration_seconds": F.lit(2.5)})
    done = {r.topic: r for r in ingest_into(corpus, "b", raw(spark, tmp_path, records), AS_OF, embed, SETTINGS, header).collect()}
    assert {t: (r.status, r.fetched, r.new) for t, r in done.items()} == {
        "fine": ("success", 1, 1), "slow": ("rate_limited", 0, 0), "broken": ("failed", 0, 0), "none": ("success", 0, 0), "silent": ("success", 1, 1)}
    assert sorted(r.topic for r in corpus.read("articles").collect()) == ["fine", "silent"]
    assert corpus.read("vectors").count() == 2 and corpus.read("sightings").count() == 2


def test_model_lock_and_vector_changes(spark, tmp_path):
    corpus = Corpus.create(spark, str(tmp_path / "corpus"), SETTINGS)
    ingest_into(corpus, "b", raw(spark, tmp_path, [record(i, f"Story {i}") for i in range(3)]), AS_OF, embed, SETTINGS)
    for other in (Settings(embed_model="other", embed_dim=8), Settings(embed_model="hash", embed_dim=4)):
        with pytest.raises(EmbeddingMismatch):
            ingest_into(corpus, "c", raw(spark, tmp_path, [record(9)], f"c{other.embed_dim}{other.embed_model}"), AS_OF, embed, other)
        with pytest.raises(EmbeddingMismatch):
            Corpus.create(spark, str(tmp_path / "corpus"), other)
    with pytest.raises(EmbeddingMismatch):
        vectors.nearest(corpus.read("vectors"), [1.0] * 4, dim=8)
    one = corpus.read("vectors").where("id = 1")
    corpus.put_vectors(one.withColumn("title", F.lit("new title")))
    corpus.delete_vectors(spark.createDataFrame([(2,), (77,)], "id long"))
    assert {r.id: r.title for r in corpus.read("vectors").collect()} == {1: "new title", 3: "Story 2"}
    corpus.put_vectors(one.withColumn("id", F.lit(2).cast("long")))
    assert sorted(r.id for r in corpus.read("vectors").collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="EmbeddingMismatch"):
        corpus.put_vectors(one.withColumn("embedding", F.slice("embedding", 1, 4)))


def test_vector_changes_are_folded_into_the_batches_they_touch(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "corpus")
    corpus = Corpus.create(spark, root, SETTINGS)
    for b in range(3):
        ingest_into(corpus, f"day:{b}", raw(spark, tmp_path, [record(10 * b + i, f"Story {b} {i}") for i in range(3)], f"r{b}"), AS_OF, embed, SETTINGS)
    state = lambda: {r.id: r.title for r in corpus.read("vectors").collect()}
    assert corpus.fold_vectors() == 0 and len(before := state()) == 9
    rows = corpus.read("vectors").where("id in (1, 5)")
    corpus.put_vectors(rows.withColumn("title", F.lit("first")))
    corpus.put_vectors(rows.where("id = 5").withColumn("title", F.lit("second")))
    corpus.put_vectors(rows.where("id = 1").withColumn("id", F.lit(500).cast("long")))
    corpus.delete_vectors(spark.createDataFrame([(2,), (77,)], "id long"))
    want = before | {1: "first", 5: "second", 500: before[1]}
    del want[2]
    assert state() == want

    # a fold that fails before its last row changes nothing, and the next one is right
    with monkeypatch.context() as m:
        m.setattr(corpus, "_stored", lambda t, whole=corpus._stored, calls=[]: calls.append(t) or (whole(t) if len(calls) < 2 else 1 / 0))
        with pytest.raises(ZeroDivisionError):
            corpus.fold_vectors()
    assert state() == want and corpus._folded() == 0
    assert corpus.fold_vectors() == 2 and state() == want and corpus.fold_vectors() == 0
    assert corpus._changes(corpus._folded()).isEmpty()
    live = {r.batch.split("~")[0]: "~" in r.batch for r in corpus._live("vectors").select("batch").distinct().collect()}
    assert live == {"day:0": True, "day:1": True, "day:2": False, "put": True}

    # changes after a fold, a batch that loses all its rows, and a batch written after it
    corpus.delete_vectors(spark.createDataFrame([(4,), (5,), (6,)], "id long"))
    corpus.put_vectors(corpus.read("vectors").where("id in (3, 500)").withColumn("title", F.lit("third")))
    want = {k: v for k, v in want.items() if k not in (4, 5, 6)} | {3: "third", 500: "third"}
    assert state() == want
    assert corpus.fold_vectors() == 3 and state() == want
    ingest_into(corpus, "day:3", raw(spark, tmp_path, [record(40, "Late story")], "r3"), AS_OF, embed, SETTINGS)
    assert sorted(state()) == sorted([*want, 10])
    assert Corpus(spark, root).read("vectors").count() == len(want) + 1


def test_scratch_cleans_up(spark):
    import os

    with Scratch(spark) as scratch:
        scratch.cut(spark.range(3), "x")
        assert os.path.isdir(scratch.root.removeprefix("file:"))
    assert not os.path.exists(scratch.root.removeprefix("file:"))


def test_uncommitted_batch_is_invisible(spark, tmp_path):
    corpus = Corpus.create(spark, str(tmp_path / "corpus"))

    def broken(df):
        return embed_texts(df, "document", lambda: lambda texts: [[1.0]] * len(texts), "short", 8)

    with pytest.raises(Exception, match="EmbeddingMismatch"):
        ingest_into(corpus, "b", raw(spark, tmp_path, [record(1)]), AS_OF, broken, SETTINGS)
    assert corpus.read("articles").count() == 0 and not corpus.is_committed("b")
    assert [r.status for r in corpus.runs().collect()] == ["partial"]
    done = ingest_into(corpus, "b", raw(spark, tmp_path, [record(1)], "again"), AS_OF, embed, SETTINGS)
    assert done.first()["new"] == 1 and corpus.read("vectors").count() == 1


def test_header_statuses(spark):
    summary = spark.createDataFrame([("b", "x", 3, 2, 1)], "batch string, topic string, fetched long, new long, skipped long")
    header = spark.createDataFrame(
        [("b", "x", False, None), ("b", "slow", True, "429"), ("b", "broken", False, "boom"), ("b", "none", None, None)],
        "batch string, topic string, rate_limited boolean, error string")
    rows = {r.topic: r for r in crawl.with_header(summary, header, ["batch", "topic"]).collect()}
    assert {t: r.status for t, r in rows.items()} == {
        "x": "success", "slow": "rate_limited", "broken": "failed", "none": "success"}
    assert (rows["x"].new, rows["slow"].fetched, rows["none"].fetched) == (2, 0, 0)
    bad = spark.createDataFrame([("odd",)], "status string")
    with pytest.raises(FeedError):
        crawl.check_statuses(bad)


def test_embedding(spark):
    import hashlib
    import math

    rows = spark.createDataFrame([("a",), ("é",)], "v string").select("v", hash_embedding(F.col("v"), 8).alias("e"))
    for r in rows.collect():
        raw_ = [b / 255 for b in hashlib.sha256(r.v.encode()).digest()[:8]]
        norm = math.sqrt(sum(x * x for x in raw_))
        assert r.e == pytest.approx([x / norm for x in raw_], abs=1e-6)
    with pytest.raises(EmbeddingMismatch):
        hash_embedding(F.col("v"), 33)
    assert embed_query("Tea, tea and TEA", 16) == hashed_words(16)()(["tea tea  and tea"])[0].astype("float32").tolist()
    assert sum(x * x for x in embed_query("Tea and more", 64)) == pytest.approx(1) and embed_query("", 4) == [0.0] * 4
    model = embed_texts(rows, "v", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], "len", 2, "m")
    assert [r.m for r in model.collect()] == [[1.0, 1.0], [1.0, 1.0]]
    assert embed_texts(rows.limit(0), "v", lambda: None, "none", 2, "m").count() == 0


def test_json_and_export(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "é\"")], "a int, b string, c string")
    assert json.loads(as_json(df).first()[0]) == {"a": 1, "b": None, "c": "é\""}
    export(df, str(tmp_path / "out"), "parquet")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


# ---- streams -----------------------------------------------------------------------

def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    records = [
        record(i, f"Story {rng.randint(1, 40)}", url=f"https://h/{rng.randint(1, 60)}", publisher=f"P{rng.randint(1, 2)}",
               date=f"2026-06-{rng.randint(1, 15):02d}")
        for i in range(120)
    ]
    folder = tmp_path / "in"
    folder.mkdir()
    for part in range(3):
        (folder / f"{part}.json").write_text("\n".join(json.dumps(r) for r in records[part * 40:part * 40 + 40]))
        # The file source takes files by age.
        import os
        os.utime(folder / f"{part}.json", (1_700_000_000 + part, 1_700_000_000 + part))
    corpus = Corpus.create(spark, str(tmp_path / "corpus"))
    for _ in range(2):  # the second start finds nothing new
        query = ingest_stream(stream_feed(spark, str(folder), files_per_batch=1), corpus, str(tmp_path / "state"), AS_OF, embed, SETTINGS)
        query.awaitTermination(300)
    one = ingest_batch(raw(spark, tmp_path, records), Scratch(spark), AS_OF, SETTINGS)
    columns = ["id", "title", "url", "composite_key"]
    assert corpus.read("articles").select(columns).orderBy("id").collect() == one.articles.select(columns).orderBy("id").collect()
    assert corpus.commits().count() == 3
    ledger = ["composite_key", "seen_count", "article_id"]
    assert (dedup.seen_ledger(corpus.read("sightings")).select(ledger).orderBy("composite_key").collect()
            == dedup.seen_ledger(one.sightings).select(ledger).orderBy("composite_key").collect())


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_stream_without_order(spark, tmp_path, fmt):
    """Files without ``ord`` in micro-batches give the articles of the numbered feed in one batch."""
    rng = random.Random(3)
    records = [record(i, f"Story {rng.randint(1, 30)}", url=f"https://h/{rng.randint(1, 50)}", publisher=f"P{rng.randint(1, 2)}") for i in range(90)]
    one = ingest_batch(raw(spark, tmp_path, records), Scratch(spark), AS_OF, SETTINGS)
    folder = tmp_path / "in"
    for part in range(3):
        some = [{k: v for k, v in r.items() if k != "ord"} for r in records[part * 30:part * 30 + 30]]
        where = folder / f"step-{part}"
        if fmt == "json":
            where.mkdir(parents=True)
            (where / "feed.json").write_text("\n".join(json.dumps(r) for r in some))
        else:
            plain = tmp_path / f"plain-{part}"
            plain.mkdir()
            (plain / "feed.json").write_text("\n".join(json.dumps(r) for r in some))
            feeds.read_feed(spark, str(plain)).drop("ord", *feeds.PLACE).coalesce(1).write.parquet(str(where))
    corpus = Corpus.create(spark, str(tmp_path / "corpus"))
    ingest_stream(stream_feed(spark, f"{folder}/*", fmt, files_per_batch=1), corpus, str(tmp_path / "state"), AS_OF, embed, SETTINGS).awaitTermination(300)
    columns = ["id", "title", "url", "composite_key"]
    assert corpus.read("articles").select(columns).orderBy("id").collect() == one.articles.select(columns).orderBy("id").collect()
    assert corpus.commits().count() == 3


def test_micro_batch_does_not_shuffle_the_history(spark):
    known = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("composite_key"))
    batch = known.limit(50).unionByName(spark.createDataFrame([("new",)], "composite_key string"))
    scratch = Scratch(spark)
    batch = scratch.cut(batch, "batch")
    marks = batch.select(F.xxhash64("composite_key").alias("__mark")).distinct()
    plan = known.withColumn("__mark", F.xxhash64("composite_key")).join(F.broadcast(marks), "__mark", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") <= 1  # the batch's own distinct
    assert dedup.touched(known, batch, "composite_key", scratch).count() == 50
    assert dedup.touched(known, batch, "composite_key", scratch, most=10).count() == 200_000


def test_accepted_alerts_follow_commits(spark, tmp_path):
    """Late articles are counted apart, alerts come once, and a step that runs again changes nothing."""
    corpus = Corpus.create(spark, str(tmp_path / "corpus"), SETTINGS)
    screened = spark.createDataFrame([("AI", 2, "https://a", True), ("AI", 9, "https://b", True), ("AI", 1, "x", False)],
                                     "topic string, threshold int, webhook_url string, accepted boolean")
    alerts = AcceptedAlerts(corpus, str(tmp_path / "alerts"), screened, lateness_days=1)

    def batch(name, days):
        rows = [record(i, f"Title {name} {i}", url=f"https://h/{name}/{i}", topic="AI", date=f"2026-06-{d:02d}") for i, d in enumerate(days)]
        folder = tmp_path / f"feed-{name}"
        folder.mkdir()
        ingest_into(corpus, name, raw(spark, folder, rows), AS_OF, embed, SETTINGS)
        alerts.run(str(tmp_path / "state"))

    def rows(table):
        return sorted((r.day.day, r.articles) for r in alerts.read(table).collect())

    batch("one", [1, 1, 1, 2, 4])
    assert rows("alerts") == [(1, 3)] and rows("late") == []  # days up to the third are closed
    batch("two", [1, 4, 4, 6])
    assert rows("late") == [(1, 1)] and rows("alerts") == [(1, 3), (4, 3)]
    alerts.step(corpus.commits().where("batch = 'two'"), 1)  # the second step again
    assert rows("late") == [(1, 1)] and rows("alerts") == [(1, 3), (4, 3)]


def test_alert_stream_equals_batch(spark, tmp_path):
    rows = [(f"t{i % 3}", f"2026-06-{1 + i % 9:02d} 10:00:00") for i in range(90)]
    folder = str(tmp_path / "articles")
    source = spark.createDataFrame(rows, "topic string, at string").select("topic", F.col("at").cast("timestamp_ntz").alias("published_at"))
    source.coalesce(1).write.parquet(folder)
    screened = spark.createDataFrame([("t0", 5, "https://a", True), ("t1", 99, "https://b", True), ("t2", 1, "x", False)],
                                     "topic string, threshold int, webhook_url string, accepted boolean")
    stream = spark.readStream.schema(source.schema).parquet(folder)
    out = str(tmp_path / "out")
    query = (alert_stream(stream, screened).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination(300)
    batch = alert_stream(spark.read.parquet(folder), screened)
    # Days that end before the newest row minus the allowed lateness are closed.
    closed = batch.where("date < '2026-06-07'")
    assert spark.read.parquet(out).select(batch.columns).orderBy("date").collect() == closed.orderBy("date").collect()
    assert batch.count() == 3 and daily_counts(source).agg(F.sum("articles")).first()[0] == 90


def test_raw_feed_schema_reads_parquet(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([], RAW_FEED).write.parquet(path)
    assert feeds.normalise_feed(feeds.read_feed(spark, path, "parquet")).count() == 0
