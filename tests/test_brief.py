"""Briefs, sentiment and alerts."""

import pytest
from pyspark.sql import functions as F

from pressroom.errors import ScorerMissing, WebhookRefused
from pressroom.operators import brief as B
from pressroom.operators import monitor as M
from pressroom.runtime import Scratch


def ranked(spark, n=2):
    rows = [("AI", 1, "Big \"news\"", "https://a", "Coast Wire", "Tue, 03 Mar 2026 08:15:00 GMT", "s1", "2026-03-03 08:15:00"),
            ("AI", 2, "More", "https://b", None, None, None, None),
            ("AI", 3, "Third", "", "North Post", "Wed, 04 Mar 2026 09:30:00 GMT", "s3", "2026-03-04 09:30:00")]
    return spark.createDataFrame(
        rows[:n], "topic string, place int, title string, url string, publisher string, published_date string, "
        "summary string, published_at string").withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


def topics(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "topic string")


def replying(text):
    return B.model_scorer(lambda: lambda prompts: [text] * len(prompts))


def test_blocks_and_prompts(spark):
    row = B.blocks(ranked(spark), ["topic"], B.brief_line()).first()
    assert row.block == ('[1] Big "news" — Coast Wire (Tue, 03 Mar 2026 08:15:00 GMT)\n    URL: https://a\n    Summary: s1\n'
                         "[2] More — unknown (date unknown)\n    URL: https://b\n    Summary: ")
    assert row.article_count == 2 and row.urls == ["https://a", "https://b"]
    prompt = B.brief_prompts(ranked(spark), 7).first()["prompt"]
    assert "note on AI, covering the past 7 days" in prompt and row.block in prompt and "Field summary" in prompt
    line = B.blocks(ranked(spark), ["topic"], B.sentiment_line()).first()["block"]
    assert line == '- Big "news" — Coast Wire (Tue, 03 Mar 2026 08:15:00 GMT)\n  s1\n- More — unknown (?)\n  '
    assert "speak about AI?" in B.sentiment_prompts(ranked(spark)).first()["prompt"]


def test_top_articles(spark):
    hits = spark.range(100).select((F.col("id") % 2).alias("topic"), "id")
    top = B.top_articles(hits, ["topic"], [F.desc("id")], 3).collect()
    assert sorted((r.topic, r.place, r.id) for r in top) == [(0, 1, 98), (0, 2, 96), (0, 3, 94), (1, 1, 99), (1, 2, 97), (1, 3, 95)]


def test_brief(spark):
    reply = '```json\n{"summary": "S", "citations": ["https://a"], "sentiment": "mixed"}\n```'
    got = {r.topic: r for r in B.brief(topics(spark, "AI", "it's"), ranked(spark), replying(reply)).collect()}
    assert (got["AI"].summary, got["AI"].citations, got["AI"].sentiment, got["AI"].article_count) == ("S", ["https://a"], "mixed", 2)
    empty = got["it's"]
    assert empty.summary == 'No articles for "it\'s" in the last 7 days.'
    assert (empty.citations, empty.sentiment, empty.article_count, empty.reply_ok) == ([], "neutral", 0, True)
    bare = B.brief(topics(spark, "AI"), ranked(spark, 3), replying('{"summary": "S"}')).first()
    assert bare.citations == ["https://a", "https://b"] and bare.article_count == 3
    assert "citations" not in B.brief(topics(spark, "AI"), ranked(spark), replying(reply), include_citations=False).columns
    assert not B.brief(topics(spark, "AI"), ranked(spark), replying("sorry")).first()["reply_ok"]


def test_scorer_is_needed_only_with_articles(spark):
    none = ranked(spark).limit(0)
    assert B.brief(topics(spark, "AI"), none, None).first()["summary"] == "No articles for 'AI' in the last 7 days."
    with pytest.raises(ScorerMissing):
        B.brief(topics(spark, "AI"), ranked(spark), None)
    with pytest.raises(ScorerMissing):
        B.sentiment(topics(spark, "AI"), none, None)


def test_sentiment(spark):
    reply = '{"overall": "positive", "score": 0.6, "rationale": "r"}'
    got = {r.topic: tuple(r)[1:5] for r in B.sentiment(topics(spark, "AI", "B"), ranked(spark), replying(reply)).collect()}
    assert got == {"AI": ("positive", 0.6, "r", 2), "B": ("neutral", 0.0, "no articles", 0)}
    days = B.sentiment_timeline(ranked(spark, 3), replying(reply)).orderBy("date").collect()
    assert [(r.date, r.article_count, r.score) for r in days] == [("2026-03-03", 1, 0.6), ("2026-03-04", 1, 0.6)]
    observed = B.sentiment_timeline(ranked(spark, 3), replying(reply), compat="observed").orderBy("date").collect()
    assert [r.date for r in observed] == ["Tue, 03 Ma", "Wed, 04 Ma"]
    overall = B.overall_label(B.sentiment(topics(spark, "AI"), ranked(spark), replying("{}"))).first()
    assert (overall.label, overall.score, overall.rationale) == ("neutral", 0.0, None)


def test_sentiment_record(spark):
    reply = '{"overall": "positive", "score": 0.6, "rationale": "r"}'
    got = {r.topic: r for r in B.sentiment_record(topics(spark, "AI", "B"), ranked(spark, 3), replying(reply)).collect()}
    assert tuple(got["AI"].overall) == ("positive", 0.6, "r") and got["AI"].article_count == 3
    assert [(d.date, d.article_count) for d in got["AI"].timeline] == [("2026-03-03", 1), ("2026-03-04", 1)]
    assert got["B"].timeline == [] and tuple(got["B"].overall) == ("neutral", 0.0, "no articles")


def test_polarity(spark):
    rows = [("bad awful day", 1)] * 6 + [("good fine day", 0)] * 6 + [("rare", 1), ("odd", None)]
    weights = B.fit_polarity(spark.createDataFrame(rows, "text string, label int"))
    held = {r.word: r.weight for r in weights.collect()}
    assert set(held) == {"bad", "awful", "good", "fine", "day"} and held["bad"] > 1 and held["good"] < -1 and abs(held["day"]) < 0.2
    prompts = spark.createDataFrame([("t", "a bad awful thing"), ("t", "good and fine"), ("t", "")], "topic string, prompt string")
    got = {r.prompt: r.reply for r in B.polarity_scorer(weights)(prompts).collect()}
    assert '"overall":"negative"' in got["a bad awful thing"] and '"overall":"positive"' in got["good and fine"] and '"score":0.0' in got[""].replace("-0.0", "0.0")


def test_alerts(spark):
    registrations = spark.createDataFrame(
        [("AI", None, None), ("AI", 6, "https://h/x"), ("AI", 7, "https://h/y"), ("AI", 1, "https://10.0.0.1/"), ("B", 1, "")],
        "topic string, threshold int, webhook_url string")
    screened = M.screen_registrations(registrations)
    assert screened.where("not accepted").count() == 1
    new = spark.createDataFrame([("AI",)] * 6, "topic string")
    got = sorted((r.threshold, r.webhook_url, r.articles) for r in M.topic_alerts(screened, new, Scratch(spark)).collect())
    assert got == [(5, None, 6), (6, "https://h/x", 6)]
    with pytest.raises(WebhookRefused):
        M.check_registrations(registrations)
    assert M.check_registrations(registrations.where("threshold = 6")).count() == 1
