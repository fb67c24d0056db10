"""Keyword search with BM25 over title, summary and full text.

The index is a table of tokens with positions. Queries touch the rows of
their own words only; frequencies, phrases and scores are aggregations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.stages import staged
from ..functions.text import words
from ..runtime import Scratch
from .batches import word_pieces
from .vectors import place_filter

# Fixed values of the ranking formula.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
COLUMNS = ("title", "summary", "full_text")


def split_words(articles: DataFrame) -> DataFrame:
    """(id, words, d, gap_1, gap_2): the words of an article in one list, d of them, with a null at gap_1 and gap_2 between the columns."""
    return staged(
        articles.select("id", *COLUMNS),
        "__word_",
        lambda v: {name: words(F.col(name)) for name in COLUMNS},
        lambda v: {"gap": F.array(F.lit(None).cast("string"))},
        lambda v: {
            "all": F.concat(v("title"), v("gap"), v("summary"), v("gap"), v("full_text")),
            "first": F.size(v("title")),
            "second": F.size(v("title")) + F.size(v("summary")) + 1,
        },
        lambda v: {"d": F.size(v("all")) - 2},
        keep={"all": "words", "d": "d", "first": "gap_1", "second": "gap_2"},
        sealed=False,
    )


def column_of(pos: Column, gap_1: Column, gap_2: Column) -> Column:
    """Which of COLUMNS a position stands in."""
    return F.when(pos < gap_1, 0).when(pos < gap_2, 1).otherwise(2)


def tokens(articles: DataFrame) -> DataFrame:
    """(id, d, col, pos, token): one row per word, d the words of the article.

    A row with a null token stands between two columns, so positions of
    different columns are never adjacent and articles without words appear.
    """
    # The list always holds the two separators. The outer form says so: for
    # the plain one Spark adds a size test and computes the list a second time.
    rows = split_words(articles).select("id", "d", "gap_1", "gap_2", F.posexplode_outer("words").alias("pos", "token"))
    head = F.col("pos") == F.col("gap_1")
    return rows.select("id", "d", column_of(F.col("pos"), F.col("gap_1"), F.col("gap_2")).alias("col"), "pos", "token", head.alias("is_head"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in word_pieces(whole, "words"):
            lists = batch.column("words")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lists)), sizes)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            flat = lists.flatten()
            real = flat.is_valid().to_numpy(zero_copy_only=False)
            coded = flat.filter(pa.array(real)).dictionary_encode()
            row, pos, code = row[real], pos[real], coded.indices.to_numpy().astype(np.int64)
            key = row * max(1, len(coded.dictionary)) + code
            order = np.argsort(key, kind="stable")  # positions of one word of one article stay in order
            starts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, np.int64)
            first = order[starts]
            places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)), pa.int32()), pa.array(pos[order], pa.int32()))
            kept = batch.select(["id", "d", "gap_1", "gap_2"]).take(pa.array(row[first]))
            yield pa.RecordBatch.from_arrays([*kept.columns, coded.dictionary.take(pa.array(code[first])), places], names=["id", "d", "gap_1", "gap_2", "token", "places"])


def entries(articles: DataFrame) -> DataFrame:
    """(id, d, gap_1, gap_2, token, places): one row per article and distinct word, with the word's positions.

    The words of an article are sorted and cut into runs in the piece of a batch that holds it, so nothing is shuffled
    and a task holds the arrays of one piece.
    """
    return split_words(articles).select("id", "d", "gap_1", "gap_2", "words").mapInArrow(
        _runs, "id long, d int, gap_1 int, gap_2 int, token string, places array<int>")


def postings(articles: DataFrame) -> DataFrame:
    """(token, id, tf): occurrences per word and article, counted inside the article's row."""
    return entries(articles).select("token", "id", F.size("places").cast("long").alias("tf"))


def lengths(index: DataFrame) -> DataFrame:
    """(id, n): words per article, articles without words included."""
    return index.where("is_head").select("id", F.col("d").alias("n"))


@dataclass(frozen=True)
class Index:
    rows: DataFrame
    articles: int
    words: int

    def narrowed(self, terms: Sequence[Term]) -> Index:
        """The index as far as ``terms`` need it; stored indexes open only those words."""
        return self


def build_index(articles: DataFrame, scratch: Scratch) -> Index:
    """Write the token table and count it.

    Rows stay in the task that made them and are sorted by token inside each
    file, so a lookup skips nearly all row groups and a frequent word loads no
    single task.
    """
    return open_index(scratch.cut(tokens(articles), "tokens", sort_within=["token"]))


def open_index(rows: DataFrame) -> Index:
    total = rows.where("is_head").agg(F.count("*").alias("n"), F.sum("d").alias("words")).first()
    return Index(rows, total["n"], total["words"] or 0)


@dataclass(frozen=True)
class Term:
    """One scored unit: a word, a phrase, or a word or phrase ending in a prefix."""

    words: tuple[str, ...]
    prefix: bool = False


def parse_terms(spark: SparkSession, text: str) -> list[Term]:
    """Terms of plain query text: a hyphenated word is a phrase, ``word*`` a prefix."""
    return parse_groups(spark, [[text]])[0]


def parse_groups(spark: SparkSession, groups: Sequence[Sequence[str]]) -> list[list[Term]]:
    """Terms of several groups of texts, folded in one job."""
    chunks = [[c for text in group for c in text.split()] for group in groups]
    flat = [c for some in chunks for c in some]
    if not flat:
        return [[] for _ in groups]
    folded = iter(spark.range(1).select(F.array(*[words(F.lit(c)) for c in flat]).alias("t")).first()["t"])
    return [[Term(tuple(w), c.endswith("*")) for c in some if (w := next(folded))] for some in chunks]


def _word_test(term: Term, place: int) -> Column:
    token = F.col("token")
    if term.prefix and place == len(term.words) - 1:
        return F.startswith(token, F.lit(term.words[place]))
    return token == term.words[place]


def _occurrences(rows: DataFrame, terms: list[Term]) -> DataFrame:
    """(term, id, d) once per place where a term occurs."""
    tests = [_word_test(t, i) for t in terms for i in range(len(t.words))]
    wanted = tests[0]
    for test in tests[1:]:
        wanted = wanted | test
    marks = F.array(*[
        F.when(
            _word_test(t, i),
            F.struct(F.lit(no).alias("term"), (F.col("pos") - F.lit(i)).alias("start")),
        )
        for no, t in enumerate(terms)
        for i in range(len(t.words))
    ])
    hits = rows.where(wanted).select("id", "d", F.explode(marks).alias("m")).where("m is not null")
    hits = hits.select("id", "d", "m.term", "m.start")
    if all(len(t.words) == 1 for t in terms):
        return hits.select("term", "id", "d")
    length = F.element_at(F.array(*[F.lit(len(t.words)) for t in terms]), F.col("term") + 1)
    whole = hits.groupBy("id", "term", "start").agg(F.count("*").alias("n"), F.max("d").alias("d"))
    return whole.where(F.col("n") == length).select("term", "id", "d")


def idf_of(articles: int, n: Column) -> Column:
    """Weight of a term that ``n`` of all articles hold."""
    idf = F.log((F.lit(articles) - n + 0.5) / (n + 0.5))
    return F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf)


def part_of(idf: Column, f: Column, d: Column, articles: int, total: int) -> Column:
    """What ``f`` occurrences in an article of ``d`` words add; grows with f and falls with d."""
    average = total / articles if articles else 1.0
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * d / F.lit(average))
    return idf * f * F.lit(K1 + 1) / (f + norm)


def score(
    index: Index,
    all_of: Sequence[Term] = (),
    any_of: Sequence[Term] = (),
    none_of: Sequence[Term] = (),
    columns: Sequence[str] = (),
) -> DataFrame | None:
    """(id, rank) of matching articles, smaller is better; None for no terms.

    An article matches with all of ``all_of``, one of ``any_of`` (if given)
    and none of ``none_of``. ``columns`` restricts where words may stand.
    """
    terms = [*all_of, *any_of, *none_of]
    if not all_of and not any_of:
        return None
    index = index.narrowed(terms)
    rows = index.rows
    if columns:
        rows = rows.where(F.col("col").isin([COLUMNS.index(c) for c in columns]))
    per_article = _occurrences(rows, terms).groupBy("id", "term").agg(
        F.count("*").alias("f"), F.max("d").alias("d")
    )
    spread_of = per_article.groupBy("term").agg(F.count("*").alias("n"))
    idf = idf_of(index.articles, F.col("n"))
    part = part_of(F.col("idf"), F.col("f"), F.col("d"), index.articles, index.words)
    # One row per query term, so its broadcast has the size of the query.
    scored = per_article.join(F.broadcast(spread_of.select("term", idf.alias("idf"))), "term")
    must, may = len(all_of), len(all_of) + len(any_of)
    in_all, in_any, in_none = F.col("term") < must, F.col("term").between(must, may - 1), F.col("term") >= may
    matched = scored.groupBy("id").agg(
        (-F.sum(part)).alias("rank"),
        F.count(F.when(in_all, 1)).alias("n_all"),
        F.count(F.when(in_any, 1)).alias("n_any"),
        F.count(F.when(in_none, 1)).alias("n_none"),
    )
    keep = (F.col("n_all") == must) & (F.col("n_none") == 0)
    if any_of:
        keep = keep & (F.col("n_any") > 0)
    return matched.where(keep).select("id", "rank")


def keyword_search(
    index: Index,
    articles: DataFrame,
    text: str = "",
    limit: int = 20,
    country: str | None = None,
    language: str | None = None,
    since: str | None = None,
    any_of: Sequence[str] = (),
    none_of: Sequence[str] = (),
    columns: Sequence[str] = (),
    order: str = "rank",
) -> DataFrame:
    """Articles matching all words of ``text``, best first, with ``rank``.

    Place and date filters come after scoring and do not change it. The whole
    article is read for the ``limit`` rows of the result only.
    ``order="date"`` lists the newest matches instead of the best.
    """
    spark = articles.sparkSession
    from .search import pick  # search builds on this module

    listed = parse_groups(spark, ((text,), any_of, none_of))
    ranked = score(index, *listed, columns=columns)
    if ranked is None:
        return articles.limit(0).withColumn("rank", F.lit(0.0))
    clause = place_filter(country, language)
    facts = articles if clause is None else articles.where(clause)
    if since:
        facts = facts.where(F.col("published_at") >= F.lit(since).cast("timestamp_ntz"))
    if order == "date":
        ranked = ranked.join(facts.select("id", "published_at"), "id")
        sort = [F.desc_nulls_last("published_at"), F.col("rank"), F.col("id")]
    else:
        if clause is not None or since:
            ranked = ranked.join(facts.select("id"), "id", "left_semi")
        sort = [F.col("rank"), F.col("id")]
    top = ranked.orderBy(*sort).limit(limit).select("id", "rank")
    return pick(articles, top, limit).orderBy(*sort)


