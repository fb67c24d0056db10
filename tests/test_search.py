"""Vectors, keyword ranking, search, timeline."""

import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressroom.errors import EmbeddingMismatch
from pressroom.functions.dates import parse_date
from pressroom.operators import keyword as K
from pressroom.operators import search as S
from pressroom.operators import vectors as V
from pressroom.operators.timeline import (
    corpus_stats, timeline, timeline_all_topics, timeline_last_month, timeline_last_week,
)
from pressroom.runtime import Scratch

AS_OF = "2026-06-20 00:00:00"
TEXT_ROWS = [
    ("Ferry to Bergen-2 delayed", "Harbour pilots reported fog at dawn.", None),
    ("Pilots vote", "The union reported a vote of harbour crews. ferry", None),
    ("x y", "weather café rain", None),
    ("z", "sports z z", None),
    ("q", "only rain here", "long text body with many words rain"),
]


def articles(spark, texts=TEXT_ROWS, **columns):
    rows = [(i + 1, t, s, f) for i, (t, s, f) in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, title string, summary string, full_text string")
    base = {"url": F.concat(F.lit("https://h/"), F.col("id")), "publisher_name": F.lit("P"), "country": F.lit("US"),
            "language": F.lit("en"), "topic": F.lit("t"), "published_date": F.lit("2026-06-19"),
            "ingested_at": F.lit(AS_OF).cast("timestamp_ntz")}
    df = df.withColumns({**base, **columns})
    return df.withColumn("published_at", parse_date(F.col("published_date")))


def full_text_index(texts):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(title, summary, full_text)")
    db.executemany("insert into f(rowid, title, summary, full_text) values (?, ?, ?, ?)",
                   [(i + 1, *t) for i, t in enumerate(texts)])
    return lambda match: db.execute(
        "select rowid, bm25(f) from f where f match ? order by 2, 1 limit 50", (match,)).fetchall()


def check(index, arts, want, text="", **options):
    got = [(r.id, r.rank) for r in K.keyword_search(index, arts, text, limit=50, **options).collect()]
    assert [i for i, _ in got] == [i for i, _ in sorted(want, key=lambda w: (round(w[1], 9), w[0]))]
    assert dict(got) == pytest.approx(dict(want))


def test_bm25_hand_cases(spark):
    arts = articles(spark)
    index = K.build_index(arts, Scratch(spark))
    fts = full_text_index(TEXT_ROWS)
    check(index, arts, fts("ferry AND reported"), "ferry reported")
    check(index, arts, fts("ferry OR rain"), any_of=["ferry", "rain"])
    check(index, arts, fts('"bergen 2"'), "Bergen-2")
    assert [r.id for r in K.keyword_search(index, arts, "Cafe").collect()] == [3]
    for nothing in ("ferry this week", "", "  ", "?!"):
        assert K.keyword_search(index, arts, nothing).collect() == []
    assert [r.id for r in K.keyword_search(index, arts, "it's rain?").collect()] == []


def test_bm25_random_against_full_text_module(spark):
    rng = random.Random(11)
    vocabulary = ["rain", "sun", "wind", "snow", "fog", "hail", "Él", "ice"]

    def text(n):
        return " ".join(rng.choices(vocabulary, k=rng.randint(0, n)))

    texts = [(text(4), text(12), rng.choice([None, text(20)])) for _ in range(60)]
    arts = articles(spark, texts)
    index = K.build_index(arts, Scratch(spark))
    fts = full_text_index(texts)
    check(index, arts, fts("rain AND snow"), "rain snow")
    check(index, arts, fts("rain AND rain"), "rain rain")
    check(index, arts, fts('"rain snow"'), "rain-snow")
    check(index, arts, fts('"rain rain" AND el'), "rain-rain el")
    check(index, arts, fts("s* AND fog"), "s* fog")
    check(index, arts, fts("hail OR ice"), any_of=["hail", "ice"])
    check(index, arts, fts("(rain AND sun) NOT fog"), "rain sun", none_of=["fog"])
    check(index, arts, fts("rain AND (hail OR ice) NOT fog"), "rain", any_of=["hail", "ice"], none_of=["fog"])
    check(index, arts, fts("title: rain"), "rain", columns=["title"])
    check(index, arts, fts('{title summary}: (rain AND "snow wind")'), "rain snow-wind", columns=["title", "summary"])


def test_keyword_filters_keep_scores(spark):
    arts = articles(spark, country=F.when(F.col("id") == 5, "UK").otherwise("US"),
                    published_date=F.when(F.col("id") == 3, F.lit(None)).otherwise(F.lit("2026-06-19")))
    index = K.build_index(arts, Scratch(spark))
    everywhere = {r.id: r.rank for r in K.keyword_search(index, arts, "rain").collect()}
    assert set(everywhere) == {3, 5}
    assert [(r.id, r.rank) for r in K.keyword_search(index, arts, "rain", country="UK").collect()] == [(5, everywhere[5])]
    assert [r.id for r in K.keyword_search(index, arts, "rain", since="2026-06-01").collect()] == [5]
    assert [r.id for r in K.keyword_search(index, arts, "rain", order="date").collect()] == [5, 3]
    latest = S.latest_for_topic("rain", index, arts, order="date").collect()
    assert [(r.id, r.score, r.search_mode) for r in latest] == [(5, 0.0, "keyword"), (3, 0.0, "keyword")]


def vector_table(spark, rows, **columns):
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    return df.withColumns({"country": F.lit("US"), "language": F.lit("en"), **columns})


def test_nearest_hand_cases(spark):
    table = vector_table(spark, [(1, [.1, .2, .3, .4]), (2, [.9, .8, .7, .6])],
                         country=F.when(F.col("id") == 2, "UK").otherwise("US"))
    query = [.1, .2, .3, .4]
    assert [r.id for r in V.nearest(table, query, 2).collect()] == [1, 2]
    assert [r.id for r in V.nearest(table, query, 2, country="UK").collect()] == [2]
    assert V.nearest(table, query, 2, country="FR").collect() == []
    assert V.nearest(table.limit(0), query).collect() == []
    with pytest.raises(Exception, match="dimensions"):
        V.nearest(table, [1.0, 2.0]).collect()
    with pytest.raises(EmbeddingMismatch):
        V.nearest(table, query, metric="dot")


def test_place_filter():
    assert V.place_filter() is None and V.place_filter("", None) is None


def test_place_filter_sql(spark):
    assert "country" in str(V.place_filter(country="US")) and "AND" in str(V.place_filter("US", "en")).upper()


@pytest.mark.parametrize("metric", V.METRICS)
def test_nearest_batch_brute_force(spark, metric):
    rng = np.random.default_rng(3)
    rows = np.round(rng.normal(size=(400, 6)), 1)  # coarse values, so there are ties
    rows[7] = 0
    queries = np.round(rng.normal(size=(31, 6)), 1)
    if metric == "cosine":
        norm = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
        scores = np.divide(queries @ rows.T, norm, out=np.zeros_like(norm), where=norm > 0)
    else:
        scores = 1 - ((queries[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2)
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", r.tolist()) for i, r in enumerate(queries)], "query_id string, embedding array<double>")
    for block in (4096, 7):
        got = V.nearest_batch(table, asked, 9, Scratch(spark), metric, block_queries=block).collect()
        assert len(got) == 31 * 9
        for q in range(31):
            mine = sorted((r.place, r.similarity) for r in got if r.query_id == f"q{q}")
            assert [s for _, s in mine] == pytest.approx(sorted(scores[q], reverse=True)[:9], abs=1e-9)


def test_upsert_and_checks(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, v string, seq int")
    assert sorted(map(tuple, V.upsert(old, new, "seq").collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert [r.id for r in V.delete(old, spark.createDataFrame([(1,), (1,), (9,)], "id long")).collect()] == [2]
    table = spark.createDataFrame([(1, [1.0], "m"), (2, [1.0, 2.0], "m"), (3, [1.0], "n"), (4, None, "m")],
                                  "id long, embedding array<float>, embed_model string")
    assert sorted(r.id for r in V.violations(table, "m", 1).collect()) == [2, 3, 4]
    with pytest.raises(EmbeddingMismatch):
        V.check_vectors(table, "m", 1)
    V.check_vectors(table.where("id = 1"), "m", 1)


def search_fixture(spark):
    arts = articles(spark, [("a", "s", None)] * 6,
                    published_date=F.try_element_at(F.array(*[F.lit(d) for d in (
                        "2026-06-01", "2026-06-19", "2026-06-14", None, "2026-06-25", "2026-06-13")]), F.col("id").cast("int")))
    table = vector_table(spark, [(1, [1., 0.]), (2, [.6, .8]), (3, [.8, .6]), (4, [.9, .4358899]), (5, [0., 1.]), (77, [1., 0.])])
    return arts, table


def test_semantic_search(spark):
    arts, table = search_fixture(spark)
    hits = S.semantic_search(table, arts, [1.0, 0.0], AS_OF, limit=10).collect()
    assert {r.id for r in hits} == {1, 2, 3, 4, 5}  # 77 has no article
    want = {1: .7 + .3 * np.exp(-19 / 3), 2: .42 + .3 * np.exp(-1 / 3), 3: .56 + .3 * np.exp(-2), 4: .63 + .15, 5: .3}
    assert {r.id: r.score for r in hits} == pytest.approx(want, abs=1e-6)
    assert [r.id for r in hits] == sorted(want, key=lambda i: -want[i])
    # Within 7 days: old and undated ones fall out, the border day stays.
    assert {r.id for r in S.semantic_search(table, arts, [1.0, 0.0], AS_OF, days=6).collect()} == {2, 3, 5}
    # One result asks for three neighbours, and none of those is recent enough.
    assert S.semantic_search(table, arts, [1.0, 0.0], AS_OF, days=6, limit=1).collect() == []
    pre = S.semantic_search(table, arts, [1.0, 0.0], AS_OF, days=6, limit=1, date_filter="pre").collect()
    assert [r.id for r in pre] == [2]
    observed = S.semantic_search(table, arts, [1.0, 0.0], AS_OF, compat="observed", metric="l2sq").collect()
    assert {r.id: r.score for r in observed}[5] == pytest.approx(.7 * -1 + .15)
    batch = S.search_batch(spark.createDataFrame([("q", [1.0, 0.0]), ("r", [0.0, 1.0])], "query_id string, embedding array<double>"),
                           table, arts, AS_OF, Scratch(spark), limit=10)
    assert [r.id for r in batch.where("query_id = 'q'").orderBy("place").collect()] == [r.id for r in hits]


def test_search_dispatch(spark):
    arts, table = search_fixture(spark)
    index = lambda: K.build_index(arts, Scratch(spark))
    embed = lambda text: [1.0, 0.0]
    assert S.search("a", table, arts, index, embed, AS_OF).first()["search_mode"] == "semantic"
    assert {r.search_mode for r in S.search("a", table, arts, index, embed, AS_OF, semantic=False).collect()} == {"keyword"}
    cold = S.search("a", table.limit(0), arts, index, embed, AS_OF).collect()
    assert {(r.search_mode, r.score) for r in cold} == {("keyword", 0.0)} and len(cold) == 6
    preset = S.search_news("a", table, arts, index, embed, AS_OF).collect()
    assert {r.id for r in preset} == {2, 3, 5}


def test_hydrate(spark):
    arts, _ = search_fixture(spark)
    assert sorted(r.id for r in S.hydrate(arts, spark.createDataFrame([(2,), (2,), (99,)], "id long")).collect()) == [2]


def test_timeline(spark):
    arts, table = search_fixture(spark)
    arts = arts.withColumn("topic", F.when(F.col("id") <= 3, "AI").otherwise("ai"))
    every = {r.date: r["count"] for r in timeline(arts).collect()}
    assert every["2026-06-20"] == 1 and sum(every.values()) == 6  # the undated one counts on its ingest day
    assert [r.date for r in timeline(arts, topic="AI").collect()] == ["2026-06-01", "2026-06-14", "2026-06-19"]
    assert [r.date for r in timeline(arts, start="2026-06-14", end="2026-06-19").collect()] == ["2026-06-14", "2026-06-19"]
    late = arts.withColumn("published_at", F.col("published_at") + F.expr("interval 12 hours"))
    assert [r.date for r in timeline(late, start="2026-06-14", end="2026-06-19").collect()] == ["2026-06-14", "2026-06-19"]
    assert [r.date for r in timeline(late, start="2026-06-14", end="2026-06-19", compat="observed").collect()] == ["2026-06-14"]
    assert [r.date for r in timeline(late, end="2026-06-13 11:00:00").collect()] == ["2026-06-01"]
    assert timeline(arts, days=1, start="2026-06-01", as_of=AS_OF).count() == 6
    assert timeline_last_month(arts, AS_OF).count() == 6 and timeline_last_week(arts, AS_OF).count() == 5
    assert timeline_all_topics(arts).agg(F.sum("count")).first()[0] == 6
    assert tuple(corpus_stats(arts, table, "m", 2).first()) == (6, 6, "m", 2)
    assert tuple(corpus_stats(arts.limit(0), table.limit(0), "m", 2).first()) == (0, 0, "m", 2)


def test_grid_is_one_pass_and_checks_lengths(spark):
    """Queries far beyond a block take one exchange of the vectors, whatever their number; wrong lengths are refused first."""
    rows = [(i, [float((i * p) % 17 - 8) for p in (3, 5, 7)]) for i in range(300)]
    stored = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = stored.withColumnsRenamed({"id": "query_id"}).withColumn("query_id", F.concat(F.lit("q"), F.col("query_id")))
    one = V.nearest_batch(stored, asked, 5, Scratch(spark), "cosine")
    grid = V.nearest_batch(stored, asked, 5, Scratch(spark), "cosine", block_queries=1, chunk_bytes=200)
    order = ["query_id", "place"]
    assert [(r.query_id, r.id, round(r.similarity, 9)) for r in one.orderBy(order).collect()] == [(r.query_id, r.id, round(r.similarity, 9)) for r in grid.orderBy(order).collect()]
    plan = grid._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    with pytest.raises(V.EmbeddingMismatch):
        V.nearest_batch(stored, asked, 5, Scratch(spark), dim=4)
    with pytest.raises(V.EmbeddingMismatch):
        S.semantic_search(stored, stored, [1.0, 2.0], "2026-01-01 00:00:00", dim=3)
