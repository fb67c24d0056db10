"""One registered query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Settings
from ..functions import text as T
from ..functions.dates import iso_text, recency_score, parse_date
from ..functions.replies import SENTIMENT_REPLY, with_parsed_reply
from ..functions.urls import with_canonical_url
from ..functions.webhooks import with_webhook_reason
from ..operators import brief as B
from ..operators import keyword as K
from ..operators import vectors as V
from ..operators.crawl import (
    check_statuses, close_runs, crawl_rollup, latest_runs, open_runs, with_header,
)
from ..operators.dedup import first_accepts, is_duplicate, seen_ledger, with_keys
from ..operators.embed import embed_query, word_embed
from ..operators.segments import KeywordIndex
from ..operators.skew import heavy_values
from ..operators.monitor import screen_registrations, topic_alerts
from ..operators.search import (
    hydrate, latest_for_topic, project, search, search_batch, search_news, semantic_search,
)
from ..operators.timeline import corpus_stats, timeline, timeline_all_topics, timeline_last_month, timeline_last_week, topics_of_parts
from ..plans import brief as P
from ..plans.ingest import ingest_batch, ingest_into, vector_rows
from ..runtime import Scratch, spread
from ..sources.corpus import Corpus, as_json, export
from ..sources.derived import AS_OF, DIM, MODEL, SEARCH_AS_OF, raw_feed, table
from ..sources.feed import is_valid, method_counts, read_feed
from ..streaming.alert_stream import alert_stream, daily_counts
from ..streaming.commit_stream import AcceptedAlerts
from ..streaming.ingest_stream import ingest_stream, stream_feed
from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def query_as(name: str) -> Callable[[Query], Query]:
    """Register under the name of the operator, which is imported here itself."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def _r6(column: str):
    return F.round(F.col(column), 6).alias(column)


# ---- feed -------------------------------------------------------------------

@query
def feed_normalize(spark, sf_dir):
    return views.feed(spark, sf_dir).drop("full_text")


@query
def feed_method_counts(spark, sf_dir):
    return method_counts(views.feed(spark, sf_dir))


@query
def feed_valid(spark, sf_dir):
    feed = views.feed(spark, sf_dir)
    return feed.groupBy("topic").agg(
        F.count("*").alias("fetched"), F.count(F.when(is_valid(), 1)).alias("usable")
    )


# ---- scalar functions --------------------------------------------------------

@query
def title_slug(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", T.title_slug(F.col("text")).alias("slug"))


@query
def publisher_norm(spark, sf_dir):
    return views.feed(spark, sf_dir).select("ord", T.publisher_norm(F.col("publisher_name")).alias("publisher"))


@query
def composite_key(spark, sf_dir):
    return with_keys(views.feed(spark, sf_dir)).select("ord", "composite_key")


@query
def url_canonical(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return with_canonical_url(pages, "url", "canonical", "url_hash").drop("url")


@query
def published_at(spark, sf_dir):
    """Every event's time written in one of ten forms, three of them unreadable."""
    ts = F.col("ts")
    forms = [
        "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "EEE, d MMM yyyy H:m:s 'utc'", "yyyy-MM-dd'T'HH:mm:ss'+0530'",
        "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy-M-d",
        "EEE, dd MMM yyyy HH:mm:ss 'EST'", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy",
    ]
    written = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        written = F.when(F.col("event_id") % 10 == i, F.date_format(ts, form)).otherwise(written)
    events = table(spark, sf_dir, "events").select("event_id", written.alias("published_date"))
    dated = events.withColumn("published_at", parse_date(F.col("published_date")))
    return dated.select("event_id", "published_date", iso_text(F.col("published_at")).alias("published_at"))


@query_as("recency_score")
def recency(spark, sf_dir):
    """Recency of every event, a tenth undated, with dates ten days on either side of now."""
    shifted = F.col("ts").cast("timestamp_ntz") + F.expr("interval 10 days")
    stamp = F.when(F.col("event_id") % 10 != 0, shifted)
    events = table(spark, sf_dir, "events").select("event_id", stamp.alias("published_at"))
    return events.select("event_id", F.round(recency_score(F.col("published_at"), AS_OF), 6).alias("recency"))


@query
def context_header(spark, sf_dir):
    rows = views.feed(spark, sf_dir)
    header = T.context_header(*(F.col(c) for c in ("topic", "publisher_name", "published_date", "country")))
    return rows.select("ord", header.alias("header"))


@query
def enriched_text(spark, sf_dir):
    rows = views.feed(spark, sf_dir)
    names = ("topic", "publisher_name", "published_date", "country", "title", "summary", "full_text")
    return rows.select("ord", T.enriched_text(*(F.col(c) for c in names)).alias("text"))


@query
def parse_replies(spark, sf_dir):
    """A model reply per document: bare, fenced with tag, fenced, or cut short."""
    body = F.to_json(F.struct(
        F.when(F.col("doc_id") % 3 == 0, "positive").otherwise("mixed").alias("overall"),
        (F.col("doc_id") % 200 / 100 - 1).alias("score"),
        F.col("text").alias("rationale"),
    ))
    kind = F.col("doc_id") % 4
    reply = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("```"), body, F.lit("```")))
        .otherwise(F.regexp_replace(body, r"\}$", ""))
    )
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", reply.alias("reply"))
    parsed = with_parsed_reply(docs, "reply", SENTIMENT_REPLY, "p")
    return parsed.select(
        "doc_id", F.col("p")["overall"].alias("overall"), F.round(F.col("p")["score"], 6).alias("score"),
        F.col("p")["rationale"].alias("rationale"), F.col("p").isNull().alias("corrupt"),
    )


@query
def webhook_screen(spark, sf_dir):
    """A webhook per event: host names, public and private addresses of both kinds, wrong schemes."""
    n = F.col("event_id")

    def octet(factor: int, base: int = 0):
        return ((n * factor) % 256 + base).cast("string")

    address = F.concat_ws(".", octet(1), octet(37), octet(101), octet(11))
    group = F.lower(F.hex((n * 149) % 65536))
    forms = [("::ffff:", address, ""), ("", group, "::1"), ("fe80::", group, "%eth0"), ("2001:db8:", group, "::1"),
             ("2a00:1450:", group, "::200e"), ("2001:20::", group, ""), ("2002:", group, "::1"), ("3fff:fff::", group, "")]
    six = F.element_at(F.array(*[F.concat(F.lit(a), x, F.lit(b)) for a, x, b in forms]), (F.floor(n / 16) % 8 + 1).cast("int"))
    url = (
        F.when(n % 8 == 0, F.concat(F.lit("https://hooks.example.com/"), n))
        .when(n % 8 == 1, F.concat(F.lit("http://"), address, F.lit("/x")))
        .when(n % 8 == 2, F.concat(F.lit("ftp://"), address))
        .when(n % 16 == 3, F.concat(F.lit("https:///"), n))
        .when(n % 16 == 11, F.concat(F.lit("https://["), six, F.lit("]/hook")))
        .when(n % 8 == 4, F.lit(""))
        .when(n % 8 == 5, F.concat(F.lit("https://METADATA.google.internal/"), n))
        .otherwise(F.concat(F.lit("https://"), address, F.lit(":8443/hook")))
    )
    hooks = table(spark, sf_dir, "events").select("event_id", url.alias("webhook_url"))
    return with_webhook_reason(hooks, "webhook_url")


# ---- dedup and ingest --------------------------------------------------------

def _ingest(spark, sf_dir, **options):
    scratch = Scratch(spark, "contract")
    return ingest_batch(raw_feed(spark, sf_dir), scratch, AS_OF, views.SETTINGS, **options)


@query
def dedup_accept(spark, sf_dir):
    return _ingest(spark, sf_dir).decisions.where("id is not null").select("ord", "id")


@query
def articles_build(spark, sf_dir):
    stored = _ingest(spark, sf_dir).articles
    return stored.select(
        "id", "title", "url", "url_hash", "publisher_name", "publisher_href", "published_date",
        iso_text(F.col("published_at")).alias("published_at"), "summary", "country", "language", "topic",
        "embed_model", "embed_dim", "composite_key",
    )


@query_as("seen_ledger")
def seen_ledger_counts(spark, sf_dir):
    got = _ingest(spark, sf_dir)
    return seen_ledger(got.sightings).select(
        "composite_key", "title_slug", "publisher_norm", "article_id", "seen_count",
        iso_text(F.col("first_seen")).alias("first_seen"), iso_text(F.col("last_seen")).alias("last_seen"),
    )


@query
def ingest_summary(spark, sf_dir):
    summary = _ingest(spark, sf_dir).summary
    return summary.select("topic", "fetched", "new", "skipped", F.lit("success").alias("status"))


@query
def reingest_noop(spark, sf_dir):
    """The same feed again: all known, nothing new, every sighting counted."""
    scratch = Scratch(spark, "contract")
    raw = raw_feed(spark, sf_dir)
    first = ingest_batch(raw, scratch, AS_OF, views.SETTINGS)
    known = scratch.cut(first.decisions.where("id is not null").select("composite_key", "url_hash"), "known")
    again = ingest_batch(raw, scratch, AS_OF, views.SETTINGS, known_keys=known, known_urls=known)
    return again.summary


@query
def known_keys(spark, sf_dir):
    """Which records' keys a ledger of the publishers with an even number already holds."""
    keyed = Scratch(spark, "contract").cut(
        with_keys(views.feed(spark, sf_dir)).select("ord", "publisher_norm", "composite_key"), "keyed"
    )
    even = F.regexp_extract("publisher_norm", r"(\d+)", 1).cast("int") % 2 == 0
    heavy = heavy_values(keyed, "composite_key", Scratch(spark, "contract"))
    return is_duplicate(keyed, keyed.where(even).select("composite_key"), heavy).select("ord", "is_known")


def _runs(spark, sf_dir):
    """Run log of one run per day, topic and method: some limited, some failed, some never closed, some not announced."""
    run, scratch = ["batch", "topic", "method"], Scratch(spark, "contract")
    header = scratch.cut(_header(spark, sf_dir).where("day % 13 != 0"), "header")
    got = _ingest(spark, sf_dir, by=tuple(run), header=header)
    run_id, started = F.concat_ws("/", "batch", "topic"), F.col("batch").cast("timestamp_ntz")
    closed = with_header(got.summary, header, run).withColumns({
        "run_id": F.coalesce("run_id", run_id), "started_at": F.coalesce("started_at", started)})
    finished = close_runs(closed).where(F.dayofmonth("started_at") % 11 != 0)
    return latest_runs(open_runs(header).unionByName(finished))


def _header(spark, sf_dir):
    """What is announced for every day and topic: errors of every seventh day are limited, clicks of every ninth fail."""
    day = F.substring("batch", 9, 2).cast("int")
    limited, failed = (day % 7 == 0) & (F.col("topic") == "error"), (day % 9 == 0) & (F.col("topic") == "click")
    runs = raw_feed(spark, sf_dir).groupBy("batch", "topic", "method").agg(F.count("*").alias("n"))
    return runs.select(
        F.concat_ws("/", "batch", "topic").alias("run_id"), "batch", "topic", "method", day.alias("day"), limited.alias("rate_limited"),
        F.when(limited, "429").when(failed, "timeout").alias("error"), F.col("batch").cast("timestamp_ntz").alias("started_at"),
        (F.col("n") / 8).alias("duration_seconds"),
    )


@query
def stored_per_status(spark, sf_dir):
    """Articles that runs of each status store: none if rate-limited or failed."""
    run, header = ["batch", "topic", "method"], _header(spark, sf_dir)
    got = _ingest(spark, sf_dir, header=header)
    held = got.articles.groupBy(*run).agg(F.count("*").alias("articles"))
    runs = with_header(got.summary.limit(0).select(*[F.lit(None).cast("string").alias(c) for c in run], "fetched", "new", "skipped"), header, run)
    return runs.select(*run, "status").join(held, run, "left").groupBy("status").agg(
        F.count("*").alias("runs"), F.coalesce(F.sum("articles"), F.lit(0)).alias("articles"))


FILE_ROWS = 20_000  # records of a feed file


def _feed_files(spark, sf_dir, least):
    """Files of a written feed: as many as its records need, so that what a task writes does not grow with the feed."""
    return max(least, -(-table(spark, sf_dir, "documents").count() // FILE_ROWS))


@query
def feed_order(spark, sf_dir):
    """The feed written as files without ``ord``, read back, numbered as it arrives and deduplicated."""
    scratch = Scratch(spark, "contract")
    path = scratch.path("feed")
    rows = raw_feed(spark, sf_dir).withColumn("batch", F.lit("all")).withColumn("topic", F.lit("all"))
    rows.repartitionByRange(_feed_files(spark, sf_dir, 4), "ord").sortWithinPartitions("ord").drop("ord").write.parquet(path)
    got = ingest_batch(read_feed(spark, path, "parquet"), scratch, AS_OF, views.SETTINGS)
    return got.articles.select("id", "url", "composite_key")


@query
def dedup_chains(spark, sf_dir):
    """Chains of a hundred records in which each shares its key or its URL with the next, one chain per hundred documents."""
    n = F.col("doc_id")
    links = table(spark, sf_dir, "documents").select(
        n.alias("ord"), F.concat_ws("-", F.lit("k"), (n - n % 100), F.floor((n % 100 + 1) / 2)).alias("composite_key"),
        F.concat_ws("-", F.lit("u"), (n - n % 100), F.floor(n % 100 / 2)).alias("url_hash"))
    return first_accepts(links, Scratch(spark, "contract")).select("ord")


@query
def crawl_run_log(spark, sf_dir):
    runs = check_statuses(Scratch(spark, "contract").cut(_runs(spark, sf_dir), "runs"))
    return runs.withColumn("started_at", iso_text(F.col("started_at")))


@query_as("crawl_rollup")
def crawl_rollup_by_status(spark, sf_dir):
    return crawl_rollup(_runs(spark, sf_dir))


# ---- articles and vectors ----------------------------------------------------

@query
def hydrate_articles(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 3).alias("id"))
    return project(hydrate(views.articles(spark, sf_dir), ids))


@query
def results_to_json(spark, sf_dir):
    rows = as_json(project(views.articles(spark, sf_dir)))
    fields = ("id", "title", "url", "publisher", "summary", "topic")
    return rows.select(*[F.get_json_object("json", f"$.{f}").alias(f) for f in fields])


@query_as("hash_embedding")
def hash_embeddings(spark, sf_dir):
    """Vector table of the feed with the hashed-words model: enriched text to unit vector."""
    rows = vector_rows(views.articles(spark, sf_dir), word_embed(8), 8)
    parts = [F.round(F.col("embedding")[i].cast("double"), 6).alias(f"e{i}") for i in range(8)]
    return rows.select("id", "publisher", "embed_dim", *parts)


def _vector_columns(df):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return df.select(
        "id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("head"), F.round(total, 6).alias("total")
    )


@query
def vector_upsert(spark, sf_dir):
    """Every third vector comes again twice, negated and then doubled; as many ids are new."""
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    again = stored.where("label % 3 = 0")

    def version(seq: int, factor: float, shift: int):
        return again.select(
            (F.col("id") + shift).alias("id"),
            F.transform("embedding", lambda x: (x * F.lit(factor)).cast("float")).alias("embedding"),
            (F.col("label") + seq).alias("label"), F.lit(seq).alias("seq"),
        )

    new = version(1, -1.0, 0).unionByName(version(2, 2.0, 0)).unionByName(version(3, 0.5, 1_000_000))
    return _vector_columns(V.upsert(stored, new, "seq"))


@query
def vector_delete(spark, sf_dir):
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return V.delete(stored, stored.where("label = 3")).select("id", "label")


@query
def vectors_folded(spark, sf_dir):
    """Vectors of three stored batches after two folds of changes, a batch emptied by one, and changes after both."""
    corpus = Corpus.create(spark, Scratch(spark, "contract").path("corpus"), Settings(embed_model=MODEL, embed_dim=DIM))
    empty = [F.lit(None).cast("string").alias(c) for c in ("country", "language", "publisher", "published_date", "title", "url", "document")]
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.lit(MODEL).alias("embed_model"), F.lit(DIM).alias("embed_dim"), F.col("label").cast("string").alias("topic"), *empty)
    of = lambda *labels: rows.where(F.col("topic").isin(*labels))
    for name, labels in (("low", "0123"), ("middle", "456"), ("high", "789")):
        corpus.publish(name, {"vectors": of(*labels)})
    scaled = lambda some, by: some.withColumn("embedding", F.transform("embedding", lambda x: (x * F.lit(by)).cast("float")))
    corpus.put_vectors(scaled(of(*"03"), 2.0))
    corpus.put_vectors(scaled(of("3"), 0.5).withColumn("id", F.col("id") + 1_000_000))
    corpus.delete_vectors(of(*"456"))
    corpus.fold_vectors()
    corpus.put_vectors(scaled(of("5"), -1.0))
    corpus.delete_vectors(of("0"))
    corpus.fold_vectors()
    corpus.delete_vectors(of("7"))
    corpus.put_vectors(scaled(of("3"), 4.0))
    return _vector_columns(corpus.read("vectors").withColumn("label", F.col("topic").cast("int")))


@query
def embedding_violations(spark, sf_dir):
    """Vectors of label 4 lose a dimension, those of label 7 claim another model."""
    stored = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("label") == 4, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("embedding"),
        F.when(F.col("label") == 7, F.lit("other")).otherwise(F.lit(MODEL)).alias("embed_model"),
    )
    found = V.violations(stored, MODEL, DIM)
    return found.select("id", F.size("embedding").alias("dim"), "embed_model")


@query
def knn_filtered(spark, sf_dir):
    hits = V.nearest(
        views.vectors(spark, sf_dir), views.query_vector(spark, sf_dir), 20, country="US", language="en"
    )
    return hits.select("id", _r6("similarity"))


@query
def knn_l2(spark, sf_dir):
    hits = V.nearest(views.vectors(spark, sf_dir), views.query_vector(spark, sf_dir), 20, metric="l2sq")
    return hits.select("id", _r6("similarity"))


@query
def knn_batch(spark, sf_dir):
    """Ten neighbours of every stored vector."""
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    queries = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = V.nearest_batch(stored, queries, 10, Scratch(spark, "contract"))
    return hits.select("query_id", "place", "id", _r6("similarity"))


@query
def knn_grid(spark, sf_dir):
    """Three neighbours of every stored vector by squared distance, queries and vectors meeting in a grid."""
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    queries = stored.withColumnRenamed("id", "query_id")
    hits = V.nearest_batch(stored, queries, 3, Scratch(spark, "contract"), "l2sq", block_queries=16, dim=DIM)
    return hits.select("query_id", "place", "id", _r6("similarity"))


# ---- search ------------------------------------------------------------------

@query_as("semantic_search")
def semantic_search_recent(spark, sf_dir):
    hits = semantic_search(
        views.vectors(spark, sf_dir), views.articles(spark, sf_dir), views.query_vector(spark, sf_dir),
        SEARCH_AS_OF, days=5, country="US", language="en", limit=10,
    )
    return hits.withColumn("score", F.round("score", 6))


@query
def semantic_search_prefilter(spark, sf_dir):
    hits = semantic_search(
        views.vectors(spark, sf_dir), views.articles(spark, sf_dir), views.query_vector(spark, sf_dir),
        SEARCH_AS_OF, days=5, limit=10, date_filter="pre", metric="l2sq", compat="observed",
    )
    return hits.select("id", _r6("score"), "search_mode")


def _index(spark, sf_dir):
    return K.build_index(views.articles(spark, sf_dir), Scratch(spark, "contract"))


@query
def search_fallback(spark, sf_dir):
    """No vectors stored, so a semantic search becomes a keyword search."""
    hits = search(
        "Tion, ble!", views.vectors(spark, sf_dir).limit(0), views.articles(spark, sf_dir),
        lambda: _index(spark, sf_dir), lambda _: [0.0] * DIM, AS_OF, days=20, language="en", limit=10,
    )
    return hits.select("id", "title", "publisher", "score", "search_mode", _r6("rank"))


@query_as("latest_for_topic")
def latest_for_topic_by_rank(spark, sf_dir):
    hits = latest_for_topic("ing", _index(spark, sf_dir), views.articles(spark, sf_dir))
    return hits.select("id", "title", "score", _r6("rank"))


def _embedded(spark, sf_dir):
    """All articles with vectors of their enriched text, stored once."""
    rows = vector_rows(views.articles(spark, sf_dir), word_embed(DIM), DIM)
    return Scratch(spark, "contract").cut(rows.select("id", "embedding", "country", "language"), "embedded")


@query
def search_text(spark, sf_dir):
    """A query text embedded, searched and ranked, over all articles."""
    hits = search(
        "Tion of the erble, 2024!", _embedded(spark, sf_dir), views.articles(spark, sf_dir), lambda: _index(spark, sf_dir),
        lambda text: embed_query(text, DIM), AS_OF, days=20, language="en", limit=10,
    )
    return hits.select("id", "title", _r6("score"), "search_mode")


@query_as("search_news")
def search_news_text(spark, sf_dir):
    """The preset: seven days, US, English, ten results."""
    hits = search_news(
        "Click and view", _embedded(spark, sf_dir), views.articles(spark, sf_dir), lambda: _index(spark, sf_dir),
        lambda text: embed_query(text, DIM), AS_OF,
    )
    return hits.select("id", "title", _r6("score"), "search_mode")


@query_as("search_batch")
def search_many(spark, sf_dir):
    """Five recent results for every stored vector as a query."""
    queries = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = search_batch(
        queries, queries.withColumnRenamed("query_id", "id"), views.articles(spark, sf_dir),
        SEARCH_AS_OF, Scratch(spark, "contract"), days=5, limit=5,
    )
    return hits.select("query_id", "place", "id", "title", "topic", _r6("score"))


@query
def tokens(spark, sf_dir):
    rows = K.postings(views.articles(spark, sf_dir))
    return rows.groupBy("token").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("articles"))


@query
def postings(spark, sf_dir):
    return K.postings(views.articles(spark, sf_dir))


@query
def article_lengths(spark, sf_dir):
    return K.lengths(K.tokens(views.articles(spark, sf_dir)))


@query
def keyword_search(spark, sf_dir):
    hits = K.keyword_search(
        _index(spark, sf_dir), views.articles(spark, sf_dir), "tion ble", limit=20, country="US", since="2024-01-05"
    )
    return hits.select("id", "title", "topic", _r6("rank"))


@query
def keyword_phrase(spark, sf_dir):
    hits = K.keyword_search(_index(spark, sf_dir), views.articles(spark, sf_dir), "of-the wh*", limit=50)
    return hits.select("id", _r6("rank"))


@query
def keyword_any(spark, sf_dir):
    hits = K.keyword_search(
        _index(spark, sf_dir), views.articles(spark, sf_dir), any_of=["tion", "ing"], none_of=["ble"],
        columns=["title"], limit=50,
    )
    return hits.select("id", _r6("rank"))


@query
def index_upkeep(spark, sf_dir):
    """Three batches indexed as they come, a seventh of the articles removed, half of those changed and put back, two segments merged."""
    rows = views.articles(spark, sf_dir).select("id", *K.COLUMNS)
    third = table(spark, sf_dir, "documents").count() // 3
    index = KeywordIndex.create(spark, Scratch(spark, "contract").path("index"))
    for no, test in enumerate((F.col("id") < third, F.col("id").between(third, 2 * third - 1), F.col("id") >= 2 * third)):
        index.add(f"batch-{no}", rows.where(test))
    index.remove(rows.where("id % 7 = 0"))
    index.add("changed", rows.where("id % 14 = 0").withColumn("title", F.concat("title", F.lit(" renewed"))))
    index.compact("merged", ["batch-0", "batch-1"])
    now = index.open()
    found = [
        K.score(now, K.parse_terms(spark, text)).select(F.lit(text).alias("search"), "id", _r6("rank"))
        for text in ("tion ble", "of-the wh*", "renewed tion")
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def keyword_blockmax(spark, sf_dir):
    """The twenty best articles by blocks' bounds, over a stored index."""
    index = KeywordIndex.create(spark, Scratch(spark, "contract").path("index"), window=256)
    index.add("all", views.articles(spark, sf_dir))
    return index.open().best("tion ble", 20).rows.select("id", _r6("rank"))


# ---- aggregations ------------------------------------------------------------

@query
def timeline_daily(spark, sf_dir):
    return timeline(views.articles(spark, sf_dir))


@query
def timeline_range(spark, sf_dir):
    return timeline(views.articles(spark, sf_dir), topic="click", start="2024-01-10", end="2024-01-20")


@query
def timeline_range_observed(spark, sf_dir):
    return timeline(views.articles(spark, sf_dir), days=20, end="2024-01-25", as_of=AS_OF, compat="observed")


@query
def timeline_presets(spark, sf_dir):
    """The presets of a month and of a week, of all topics and of one."""
    rows = views.articles(spark, sf_dir)
    made = {"month": timeline_last_month(rows, AS_OF), "week": timeline_last_week(rows, AS_OF), "clicks": timeline_last_week(rows, AS_OF, "click")}
    parts = [df.select(F.lit(name).alias("preset"), "date", "count") for name, df in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def timeline_stored(spark, sf_dir):
    """Timelines from the daily counts of two stored batches, a seventh of whose articles was removed; articles are not read."""
    corpus = Corpus.create(spark, Scratch(spark, "contract").path("corpus"))
    rows = views.articles(spark, sf_dir)
    for name, test in (("odd", F.col("id") % 2 == 1), ("even", F.col("id") % 2 == 0)):
        corpus.publish(name, {"articles": rows.where(test).withColumn("url_hash", F.lit(None).cast("string")).withColumn("composite_key", F.lit(None).cast("string"))})
    corpus.remove_articles(rows.where("id % 7 = 0").select("id"))
    days = corpus.timeline(start="2024-01-05", end="2024-01-25").select(F.lit("all topics").alias("topic"), "date", "count")
    return days.unionByName(topics_of_parts(corpus.daily()))


@query
def exported_articles(spark, sf_dir):
    """Search rows exported as JSON files and read back."""
    path = Scratch(spark, "contract").path("export")
    rows = project(views.articles(spark, sf_dir))
    export(rows, path, "json")
    return spark.read.schema(rows.schema).json(path)


@query_as("timeline_all_topics")
def timeline_topics(spark, sf_dir):
    return timeline_all_topics(views.articles(spark, sf_dir))


@query_as("corpus_stats")
def stats(spark, sf_dir):
    return corpus_stats(views.articles(spark, sf_dir), table(spark, sf_dir, "embeddings"), MODEL, DIM)


# ---- briefs, sentiment, alerts -------------------------------------------------

def _ranked(spark, sf_dir, n):
    """The newest n articles per topic, as search would hand them on."""
    rows = project(views.articles(spark, sf_dir), "published_at")
    return B.top_articles(rows, ["topic"], [F.desc("published_at"), F.col("id")], n)


@query
def brief_block(spark, sf_dir):
    found = B.blocks(_ranked(spark, sf_dir, 20), ["topic"], B.brief_line())
    return found.select("topic", "block", "article_count", F.array_join("urls", " ").alias("urls"))


@query
def brief_prompt(spark, sf_dir):
    return B.brief_prompts(_ranked(spark, sf_dir, 20), 7).select("topic", "prompt")


@query
def brief_result(spark, sf_dir):
    """Replies per topic: with and without citations, one cut short; half the topics are empty."""
    prompts = B.brief_prompts(_ranked(spark, sf_dir, 20), 7)
    text = F.concat(F.lit("About "), F.col("topic"), F.lit(' "'), F.element_at("urls", 1), F.lit('"'))
    full = F.to_json(F.struct(
        text.alias("summary"), F.array(F.element_at("urls", 1)).alias("citations"), F.lit("mixed").alias("sentiment")))
    bare = F.to_json(F.struct(text.alias("summary"), F.lit("positive").alias("sentiment")))
    reply = (
        F.when(F.col("topic") == "error", F.lit('{"summary": "cut'))
        .when(F.col("topic").isin("click", "view"), F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .otherwise(bare)
    )
    result = B.brief_results(views.topics(spark, sf_dir), prompts.withColumn("reply", reply), 7)
    return result.withColumn("citations", F.array_join("citations", " "))


def _scorer(spark, sf_dir):
    """Word log-odds of the labelled documents: toxic ones speak against."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = Scratch(spark, "contract").cut(B.fit_polarity(texts.join(labels, "doc_id")), "weights")
    return B.polarity_scorer(weights)


@query
def sentiment_prompt(spark, sf_dir):
    return B.sentiment_prompts(_ranked(spark, sf_dir, 15)).select("topic", "prompt", "article_count")


@query
def sentiment_overall(spark, sf_dir):
    return B.sentiment(views.topics(spark, sf_dir), _ranked(spark, sf_dir, 15), _scorer(spark, sf_dir))


@query_as("sentiment_timeline")
def sentiment_by_day(spark, sf_dir):
    """Fifteen articles of every topic and day."""
    rows = project(views.articles(spark, sf_dir), "published_at").withColumn("day", B.day_bucket())
    ranked = B.top_articles(rows, ["topic", "day"], [F.desc("published_at"), F.col("id")], 15)
    return B.sentiment_timeline(ranked, _scorer(spark, sf_dir))


def _searched(spark, sf_dir):
    """What briefs and sentiment from search start with."""
    return (views.topics(spark, sf_dir), _embedded(spark, sf_dir), views.articles(spark, sf_dir), word_embed(DIM), _scorer(spark, sf_dir), AS_OF,
            Scratch(spark, "contract"))


@query
def brief_from_search(spark, sf_dir):
    """A brief per topic of the last week: searched by the topic's text, cut, prompted, scored and parsed."""
    return P.brief_last_week(*_searched(spark, sf_dir)).withColumn("citations", F.array_join("citations", " "))


@query
def sentiment_from_search(spark, sf_dir):
    return P.sentiment_last_fortnight(*_searched(spark, sf_dir))


@query
def sentiment_timeline_full(spark, sf_dir):
    """One record per topic: overall verdict, days, article count."""
    found = P.sentiment_last_week(*_searched(spark, sf_dir), timeline=True)
    day = lambda d: F.concat_ws(" ", d["date"], d["overall"], F.format_number(d["score"], 3), d["article_count"].cast("string"))
    return found.select(
        "topic", F.col("overall")["label"].alias("label"), F.col("overall")["score"].alias("score"),
        F.array_join(F.transform("timeline", day), "; ").alias("timeline"), "article_count",
    )


@query_as("topic_alerts")
def alerts(spark, sf_dir):
    """A registration per user and topic; the threshold is how active the user is on it."""
    user = F.col("user_id").cast("string")
    registrations = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("topic")).agg(
        F.count("*").cast("int").alias("threshold")
    ).withColumn(
        "webhook_url",
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("https://10.0.0.1/"), user))
        .when(F.col("user_id") % 3 == 1, F.concat(F.lit("https://hooks.example.com/"), user)),
    )
    screened = Scratch(spark, "contract").cut(screen_registrations(registrations), "screened")
    found = topic_alerts(screened, views.feed(spark, sf_dir).where(is_valid()), Scratch(spark, "contract"))
    return found.groupBy("topic", "threshold", "webhook_url").agg(
        F.max("articles").alias("articles"), F.count("*").alias("registrations")
    )


# ---- streams -------------------------------------------------------------------

def _halves(spark, sf_dir):
    """The number at which the feed is cut into two batches."""
    return (table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0) // 2


@query
def streamed_ingest(spark, sf_dir):
    """The feed as files without ``ord``, half of it at a time, ingested into a new corpus by micro-batches of one stream that goes on."""
    scratch = Scratch(spark, "stream")
    path, state, half = scratch.path("feed"), scratch.path("state"), _halves(spark, sf_dir)
    rows = raw_feed(spark, sf_dir).withColumns({"batch": F.lit("all"), "topic": F.lit("all")})
    corpus = Corpus.create(spark, scratch.path("corpus"))
    settings, files = Settings(embed_model="hashed-words-8", embed_dim=8), -(-_feed_files(spark, sf_dir, 4) // 2)
    for no, test in enumerate((F.col("ord") < half, F.col("ord") >= half)):
        rows.where(test).repartitionByRange(files, "ord").sortWithinPartitions("ord").drop("ord").write.parquet(f"{path}/{no}")
        # all files of this half are one micro-batch, which numbers them by name
        raw = stream_feed(spark, f"{path}/*", "parquet", files_per_batch=files)
        ingest_stream(raw, corpus, state, AS_OF, word_embed(8), settings).awaitTermination()
    vectors = corpus.read("vectors").select("id", F.size("embedding").alias("dim"))
    return corpus.read("articles").select("id", "title", "url_hash", "composite_key").join(vectors, "id")


@query
def streamed_accepted_alerts(spark, sf_dir):
    """Accepted articles per topic and closed day, in time and late, and alerts, following the commits of two batches."""
    scratch = Scratch(spark, "stream")
    corpus, half = Corpus.create(spark, scratch.path("corpus")), _halves(spark, sf_dir)
    raw = raw_feed(spark, sf_dir)
    settings = Settings(embed_model="hashed-words-8", embed_dim=8)
    for name, test in (("1", F.col("ord") < half), ("2", F.col("ord") >= half)):
        ingest_into(corpus, name, raw.where(test), AS_OF, word_embed(8), settings)
    screened = scratch.cut(_user_thresholds(spark, sf_dir), "screened")
    alerts = AcceptedAlerts(corpus, scratch.path("alerts"), screened)
    alerts.run(scratch.path("state"), commits_per_step=1)
    closed = alerts.read("state").agg(F.max("closed").alias("closed"))
    named = [alerts.read(t).select("topic", "day", F.lit(t).alias("kind"), "articles") for t in ("counts", "late")]
    fired = alerts.read("alerts").select("topic", "day", F.lit("alerts").alias("kind"), F.lit(1).cast("long").alias("articles"))
    rows = named[0].unionByName(named[1]).unionByName(fired).join(F.broadcast(closed), F.col("day") <= F.col("closed"))
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("articles"))), F.lit(0))
    return rows.groupBy("topic", F.date_format("day", "yyyy-MM-dd").alias("date")).agg(
        total("counts").alias("articles"), total("late").alias("late"), total("alerts").alias("alerts"))


def _user_thresholds(spark, sf_dir):
    """A registration per user and topic: a tenth of the user's events."""
    registered = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("topic")).agg(F.expr("cast((count(1) + 9) div 10 as int)").alias("threshold"))
    return screen_registrations(registered.select("topic", "threshold", F.concat(F.lit("https://hooks.example.com/"), F.col("user_id").cast("string")).alias("webhook_url")))


@query
def streamed_alerts(spark, sf_dir):
    """Alerts of a stream: closed days on which a topic has a tenth or more of the events a user has on all days, per user and topic."""
    scratch = Scratch(spark, "stream")
    stored = table(spark, sf_dir, "events")
    screened = scratch.cut(_user_thresholds(spark, sf_dir), "screened")
    events = spark.readStream.schema(stored.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    found = alert_stream(events.select(F.col("event_type").alias("topic"), F.col("ts").alias("published_at")), screened)
    out = scratch.path("alerts")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch.path("state")).outputMode("append").trigger(
        availableNow=True).start().awaitTermination()
    rows = spark.read.schema(found.schema).parquet(out)
    return rows.groupBy("topic", "date", "articles").agg(F.count("*").alias("alerts"), F.min("threshold").alias("least"))


@query
def streamed_daily_counts(spark, sf_dir):
    """Topic volumes per closed day of a stream; open days are still held back."""
    scratch = Scratch(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counts = daily_counts(events.select(F.col("event_type").alias("topic"), F.col("ts").alias("published_at")))
    out = scratch.path("counts")
    counts.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", scratch.path("state")
    ).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(out)
