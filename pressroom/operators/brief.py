"""Briefs and sentiment: prompts as rows, an injected scorer, parsed replies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..errors import ScorerMissing
from ..functions.replies import BRIEF_REPLY, SENTIMENT_REPLY, has_field, with_parsed_reply
from ..functions.text import truthy, words

Scorer = Callable[[DataFrame], DataFrame]  # adds ``reply`` to rows with ``prompt``

BRIEF_PROMPT = (
    "You are preparing a desk note on {topic}, covering the past {days} days.\n\nSources (the number in brackets is the rank):\n"
    "{block}\n\nReturn a single JSON object. Field summary: two or three paragraphs that name, in brackets, the rank of every source "
    "they rest on. Field citations: the URLs used. Field sentiment: positive, negative, neutral or mixed."
)
SENTIMENT_PROMPT = (
    "How do these reports speak about {topic}?\n\n{block}\n\n"
    "Return a single JSON object. Field overall: positive, negative, neutral or mixed. Field score: -1.0 (hostile) "
    "up to 1.0 (favourable). Field rationale: at most two sentences that point to the reports."
)


def top_articles(hits: DataFrame, by: Sequence[str], order: Sequence[Column], max_articles: int) -> DataFrame:
    """The first ``max_articles`` rows per group with ``place`` from 1.

    The limit is applied before the shuffle too, so a group with a third of
    all rows sends on no more than any other.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return hits.withColumn("place", F.row_number().over(window)).where(F.col("place") <= max_articles)


def _text(column: str, default: str = "") -> Column:
    return F.coalesce(truthy(F.col(column)), F.lit(default))


def brief_line() -> Column:
    """Numbered entry of a brief prompt."""
    return F.concat(
        F.lit("["), F.col("place").cast("string"), F.lit("] "), _text("title"), F.lit(" — "),
        _text("publisher", "unknown"), F.lit(" ("), _text("published_date", "date unknown"),
        F.lit(")\n    URL: "), _text("url"), F.lit("\n    Summary: "), _text("summary"),
    )


def sentiment_line() -> Column:
    """Entry of a sentiment prompt."""
    return F.concat(
        F.lit("- "), _text("title"), F.lit(" — "), _text("publisher", "unknown"), F.lit(" ("),
        _text("published_date", "?"), F.lit(")\n  "), _text("summary"),
    )


def blocks(ranked: DataFrame, by: Sequence[str], line: Column) -> DataFrame:
    """(by, block, urls, article_count) of rows already cut to a fixed number per group."""
    entry = F.struct("place", line.alias("line"), F.col("url").alias("url"))
    grouped = ranked.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return grouped.select(
        *by,
        F.array_join(F.col("e")["line"], "\n").alias("block"),
        F.filter(F.col("e")["url"], lambda u: truthy(u).isNotNull()).alias("urls"),
        F.size("e").cast("bigint").alias("article_count"),
    )


def render(template: str, **parts: Column) -> Column:
    """Template text with ``{name}`` replaced by columns."""
    pieces: list[Column] = []
    rest = template
    while rest:
        starts = {rest.find("{" + n + "}"): n for n in parts if "{" + n + "}" in rest}
        if not starts:
            pieces.append(F.lit(rest))
            break
        at = min(starts)
        name = starts[at]
        pieces += [F.lit(rest[:at]), parts[name].cast("string")]
        rest = rest[at + len(name) + 2:]
    return F.concat(*pieces)


def brief_prompts(ranked: DataFrame, days: int, by: Sequence[str] = ("topic",)) -> DataFrame:
    found = blocks(ranked, by, brief_line())
    prompt = render(BRIEF_PROMPT, topic=F.col("topic"), days=F.lit(days), block=F.col("block"))
    return found.withColumn("prompt", prompt)


def sentiment_prompts(ranked: DataFrame, by: Sequence[str] = ("topic",)) -> DataFrame:
    found = blocks(ranked, by, sentiment_line())
    return found.withColumn("prompt", render(SENTIMENT_PROMPT, topic=F.col("topic"), block=F.col("block")))


def model_scorer(load_model: Callable[[], Callable[[list[str]], list[str]]]) -> Scorer:
    """Scorer that calls a model in batches; it is loaded once per task."""

    def score(prompts: DataFrame) -> DataFrame:
        schema = T.StructType(prompts.schema.fields + [T.StructField("reply", T.StringType())])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = None
            for pdf in batches:
                if pdf.empty:
                    continue
                model = model or load_model()
                yield pdf.assign(reply=model(pdf["prompt"].tolist()))

        return prompts.mapInPandas(run, schema)

    return score


def fit_polarity(labelled: DataFrame, least: int = 5) -> DataFrame:
    """(word, weight): smoothed log-odds of words in texts of label 1 against label 0, from (text, label).

    Each text counts a word once; words of fewer than ``least`` texts are left out.
    """
    rows = labelled.where(F.col("label").isin(0, 1)).select("label", F.array_distinct(words(F.col("text"))).alias("words"))
    totals = rows.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("ones"), F.count("*").alias("all"))
    seen = rows.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("one"), F.count("*").alias("both"))
    kept = seen.where(F.col("both") >= least).join(F.broadcast(totals))  # one row

    def share(n, of):
        return F.log((n + 1) / (of + 2))

    weight = share(F.col("one"), F.col("ones")) - share(F.col("both") - F.col("one"), F.col("all") - F.col("ones"))
    return kept.select("word", weight.alias("weight"))


def polarity_scorer(weights: DataFrame, sure: float = 0.1) -> Scorer:
    """Scorer from word weights (word, weight; positive weights speak against): no language model is called.

    The score is minus the hyperbolic tangent of the mean weight of the known words in the articles' ``block``; the
    instruction around it has no say (bare prompts are read whole). What a score means is what the labels mean: with weights of toxic texts it tells how
    toxic the reports are, which stands in for sentiment. The reply has the fields of both tasks.
    """

    def score(prompts: DataFrame) -> DataFrame:
        keyed = prompts.withColumn("__prompt", F.sha2("prompt", 256))
        told = keyed.select("__prompt", F.explode(words(F.col("block" if "block" in prompts.columns else "prompt"))).alias("word")).join(weights, "word")
        found = told.groupBy("__prompt").agg(F.avg("weight").alias("mean"), F.count("*").alias("known"))
        value = F.round(-F.tanh(F.coalesce("mean", F.lit(0.0))), 3)
        verdict = F.when(value > sure, "positive").when(value < -sure, "negative").otherwise("neutral")
        why = F.concat(F.coalesce("known", F.lit(0)).cast("string"), F.lit(" known words"))
        reply = F.to_json(F.struct(
            verdict.alias("overall"), value.alias("score"), why.alias("rationale"),
            F.concat(F.lit("Reports on "), F.col("topic"), F.lit(": "), why).alias("summary"), verdict.alias("sentiment"),
        ))
        return keyed.join(found, "__prompt", "left").withColumn("reply", reply).select(*prompts.columns, "reply")

    return score


def _need(scorer: Scorer | None) -> Scorer:
    if scorer is None:
        raise ScorerMissing("briefs and sentiment need a scorer")
    return scorer


def _quoted(text: Column) -> Column:
    """The topic in quotes: single ones unless it holds single but no double quotes."""
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    inside = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.when(double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), inside, F.lit("'"))
    )


def brief(
    topics: DataFrame, ranked: DataFrame, scorer: Scorer | None, days: int = 7, include_citations: bool = True
) -> DataFrame:
    """Cited brief per topic; topics without articles get a fixed neutral one.

    Those are settled before a scorer is asked for, so with no articles at all
    none is needed. ``reply_ok`` is false where the reply was not JSON.
    """
    if scorer is None and ranked.isEmpty():
        scored = brief_prompts(ranked, days).withColumn("reply", F.lit(None).cast("string"))
    else:
        scored = _need(scorer)(brief_prompts(ranked, days))
    return brief_results(topics, scored, days, include_citations)


def brief_results(topics: DataFrame, scored: DataFrame, days: int, include_citations: bool = True) -> DataFrame:
    """Replies joined to all topics; citations default to the article URLs."""
    parsed = with_parsed_reply(
        scored.select("topic", "urls", "article_count", "reply"), "reply", BRIEF_REPLY, "parsed"
    )
    given = has_field(F.col("reply"), "citations")
    joined = topics.select("topic").join(parsed, "topic", "left")
    empty = F.col("article_count").isNull()
    none_found = F.concat(
        F.lit("No articles for "), _quoted(F.col("topic")), F.lit(f" in the last {days} days.")
    )
    citations = F.when(empty, F.array().cast("array<string>")).when(given, F.col("parsed")["citations"])
    return joined.select(
        "topic",
        F.when(empty, none_found).otherwise(F.col("parsed")["summary"]).alias("summary"),
        *([citations.otherwise(F.col("urls")).alias("citations")] if include_citations else []),
        F.when(empty, F.lit("neutral")).otherwise(F.col("parsed")["sentiment"]).alias("sentiment"),
        F.coalesce("article_count", F.lit(0)).alias("article_count"),
        (empty | F.col("parsed").isNotNull()).alias("reply_ok"),
    )


def sentiment(topics: DataFrame, ranked: DataFrame, scorer: Scorer | None) -> DataFrame:
    """One verdict per topic; topics without articles are neutral."""
    return sentiment_results(topics, _need(scorer)(sentiment_prompts(ranked)))


def sentiment_results(topics: DataFrame, scored: DataFrame) -> DataFrame:
    parsed = with_parsed_reply(scored.select("topic", "article_count", "reply"), "reply", SENTIMENT_REPLY, "parsed")
    joined = topics.select("topic").join(parsed, "topic", "left")
    empty = F.col("article_count").isNull()
    return joined.select(
        "topic",
        F.when(empty, F.lit("neutral")).otherwise(F.col("parsed")["overall"]).alias("overall"),
        F.when(empty, F.lit(0.0)).otherwise(F.col("parsed")["score"]).alias("score"),
        F.when(empty, F.lit("no articles")).otherwise(F.col("parsed")["rationale"]).alias("rationale"),
        F.coalesce("article_count", F.lit(0)).alias("article_count"),
        (empty | F.col("parsed").isNotNull()).alias("reply_ok"),
    )


def day_bucket(compat: str = "documented") -> Column:
    """Calendar day of an article; observed: the first ten characters of its date text."""
    if compat == "observed":
        return truthy(F.substring("published_date", 1, 10))
    return F.date_format("published_at", "yyyy-MM-dd")


def sentiment_timeline(ranked: DataFrame, scorer: Scorer | None, compat: str = "documented") -> DataFrame:
    """One verdict per topic and day; articles without a day are left out."""
    dated = ranked.withColumn("date", day_bucket(compat)).where("date is not null")
    scored = _need(scorer)(sentiment_prompts(dated, ("topic", "date")))
    parsed = with_parsed_reply(
        scored.select("topic", "date", "article_count", "reply"), "reply", SENTIMENT_REPLY, "parsed"
    )
    return parsed.select(
        "topic", "date", F.col("parsed")["overall"].alias("overall"), F.col("parsed")["score"].alias("score"),
        F.col("parsed")["rationale"].alias("rationale"), "article_count",
    )


def overall_label(verdicts: DataFrame) -> DataFrame:
    """The corpus-wide slot of a sentiment timeline: label, score, rationale."""
    return verdicts.select(
        "topic", F.coalesce("overall", F.lit("neutral")).alias("label"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "rationale",
    )


BRIEF_DAYS, BRIEF_ARTICLES = 7, 20
SENTIMENT_DAYS, SENTIMENT_ARTICLES = 14, 15


def found_for_topics(hits: DataFrame) -> DataFrame:
    """Rows of a batch search whose query ids are topics, as ranked rows of these topics."""
    return hits.withColumn("topic", F.col("query_id"))


def sentiment_record(topics: DataFrame, ranked: DataFrame, scorer: Scorer | None, compat: str = "documented") -> DataFrame:
    """(topic, overall, timeline, article_count): the verdict on all articles of a topic and those of its days."""
    whole = sentiment(topics, ranked, scorer)
    label = overall_label(whole).select("topic", F.struct("label", "score", "rationale").alias("overall"))
    day = F.struct("date", "overall", "score", "rationale", "article_count")
    days = sentiment_timeline(ranked, scorer, compat).groupBy("topic").agg(F.sort_array(F.collect_list(day)).alias("timeline"))
    joined = label.join(whole.select("topic", "article_count"), "topic").join(days, "topic", "left")
    none = F.array().cast(days.schema["timeline"].dataType)
    return joined.select("topic", "overall", F.coalesce("timeline", none).alias("timeline"), "article_count")
