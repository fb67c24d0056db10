"""A stored keyword index that follows its corpus.

Each batch of articles is a segment of its own: postings in blocks, a term dictionary, article lengths, and a
commit row with its counts. Nothing is rebuilt when a batch arrives or articles go: removed articles are
listed with the segment they are in, and the counts that ranks need (articles, words, articles per word) are
those of all segments less those of the list. ``compact`` writes several segments as one and drops what is
removed. A segment without its commit row is not read, so a run that stops is simply run again.

A block holds a word's postings in one window of ids, with the number of postings, the largest count and the
smallest article length in front of them: an upper bound of what the word adds in that window, whatever the
corpus average has become. Windows are aligned over all words, so bounds of several words add up, and
``best`` reads only windows that can reach the k-th best score.

Blocks lie in folders by a hash of the word, so a lookup opens the folders of its words; a frequent word's
blocks are spread over many files of its folder by their windows. Prefixes are looked up in the dictionary,
which is sorted by word.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..errors import ConfigurationError
from . import keyword as K

BUCKETS = 32
WINDOW = 4096  # ids of one block
SPAN = 256  # windows of one file at most: a million ids
MOST_WORDS = 2000  # words of a prefix that are named in a scan; beyond, the scan tests the prefix
MOST_WINDOWS = 5000  # windows that a scan's filter may name
PROBES = 8  # windows read to find the k-th score
SLACK = 1 - 1e-9  # room for sums taken in another order

ENTRY = "STRUCT<id: BIGINT, d: INT, gap_1: INT, gap_2: INT, places: ARRAY<INT>>"
BLOCKS = f"segment STRING, bucket INT, no INT, token STRING, win BIGINT, n BIGINT, most INT, least_d INT, entries ARRAY<{ENTRY}>"
WORDS = "segment STRING, no INT, token STRING, n BIGINT, blocks BIGINT"
SIZES = "segment STRING, no INT, id BIGINT, d INT"
COMMITS = "segment STRING, no INT, articles BIGINT, words BIGINT, replaces ARRAY<STRING>"
REMOVED = "id BIGINT, no INT, d INT"


@dataclass(frozen=True)
class Best:
    """The k best articles (id, rank), and how many of the words' blocks were read for them."""

    rows: DataFrame
    blocks: int
    read: int


@dataclass(frozen=True)
class Opened:
    """The index as of one moment: segments are listed once, so a query sees one state."""

    store: KeywordIndex
    segments: tuple
    articles: int
    words: int
    removed: DataFrame | None

    def narrowed(self, terms: Sequence[K.Term]) -> K.Index:
        """Word rows of ``terms`` only, as ``keyword.score`` reads them."""
        found = self.entries(self.blocks(terms))
        rows = found.select("id", "d", "gap_1", "gap_2", "token", F.explode("places").alias("pos"))
        col = K.column_of(F.col("pos"), F.col("gap_1"), F.col("gap_2"))
        return K.Index(rows.select("id", "d", col.alias("col"), "pos", "token", F.lit(False).alias("is_head")), self.articles, self.words)

    def _live(self, table: str, schema: str) -> DataFrame:
        rows = self.store.spark.read.schema(schema).parquet(self.store._path(table))
        return rows.where(F.col("segment").isin([s.segment for s in self.segments]))

    def dictionary(self) -> DataFrame:
        """(token, n, blocks): articles and blocks per word, removed articles still counted."""
        return self._live("words", WORDS).groupBy("token").agg(F.sum("n").alias("n"), F.sum("blocks").alias("blocks"))

    def blocks(self, terms: Sequence[K.Term]) -> DataFrame:
        """Blocks of the words of ``terms``; prefixes are spelled out from the dictionary."""
        plain = {w for t in terms for i, w in enumerate(t.words) if not (t.prefix and i == len(t.words) - 1)}
        starts = {t.words[-1] for t in terms if t.prefix and t.words}
        rows = self._live("postings", BLOCKS)
        wide: list[str] = []
        for start in sorted(starts):
            named = self._live("words", WORDS).where(F.startswith("token", F.lit(start))).select("token").distinct().limit(MOST_WORDS + 1).collect()
            if len(named) > MOST_WORDS:
                wide.append(start)
            else:
                plain |= {r.token for r in named}
        test: Column = F.col("token").isin(sorted(plain))
        if not wide:
            return rows.where(F.col("bucket").isin(sorted({self.store.bucket(w) for w in plain})) & test)
        for start in wide:
            test = test | F.startswith("token", F.lit(start))
        return rows.where(test)

    def entries(self, blocks: DataFrame) -> DataFrame:
        """(token, id, d, gap_1, gap_2, places) of articles that are still there."""
        rows = blocks.select("token", "no", F.inline("entries"))
        return rows if self.removed is None else rows.join(self.removed.select("id", "no"), ["id", "no"], "left_anti")

    def _articles_with(self, blocks: DataFrame) -> DataFrame:
        """(token, n): articles that hold each word. Only blocks with removed articles are read; the others are counted by their heads."""
        heads = blocks.select("token", F.col("n"))
        if self.removed is not None:
            gone = self.removed.select("id", "no", F.floor(F.col("id") / self.store.window).alias("win"))
            touched = blocks.join(gone.select("no", "win").distinct(), ["no", "win"], "left_semi").select("token", "no", F.inline("entries"))
            less = touched.join(gone.select("id", "no"), ["id", "no"], "left_semi").groupBy("token").agg((-F.count("*")).alias("n"))
            heads = heads.unionByName(less)
        return heads.groupBy("token").agg(F.sum("n").alias("n"))

    def best(self, text: str, k: int = 10, any_word: bool = False) -> Best:
        """The k best articles that hold all words of ``text`` (with ``any_word``, one of them), by rank, then id.

        Bounds of all windows come from the blocks' heads. Some windows with the largest bounds are scored first; their
        k-th score rules out all windows that cannot reach it, and what is left is scored by words' blocks as usual.
        """
        words = sorted({w for t in K.parse_terms(self.store.spark, text) for w in t.words})
        blocks = self.blocks([K.Term((w,)) for w in words])
        weights = {r.token: r for r in self._articles_with(blocks).where("n > 0").select(
            "token", K.idf_of(self.articles, F.col("n")).alias("idf")).collect()}  # a row per word of the query
        none = Best(self.store.spark.createDataFrame([], "id long, rank double"), 0, 0)
        if not words or not weights or len(weights) < len(words) and not any_word:
            return none
        idf = F.element_at(F.create_map(*[F.lit(x) for w, r in weights.items() for x in (w, r.idf)]), F.col("token"))
        blocks = blocks.where(F.col("token").isin(list(weights)))
        highest = K.part_of(idf, F.col("most"), F.col("least_d"), self.articles, self.words)
        heads = blocks.select("token", "win", highest.alias("bound")).groupBy("win", "token").agg(F.max("bound").alias("bound"), F.count("*").alias("blocks"))
        windows = heads.groupBy("win").agg(F.sum("bound").alias("bound"), F.count("*").alias("held"), F.sum("blocks").alias("blocks"))
        total = windows.agg(F.sum("blocks")).first()[0]
        if not any_word:
            windows = windows.where(F.col("held") == len(words))

        def scored(some: DataFrame) -> DataFrame:
            part = K.part_of(idf, F.size("places"), F.col("d"), self.articles, self.words)
            sums = self.entries(some).select("id", part.alias("part")).groupBy("id").agg((-F.sum("part")).alias("rank"), F.count("*").alias("held"))
            return (sums if any_word else sums.where(F.col("held") == len(words))).select("id", "rank")

        def within(some: DataFrame, most: int) -> DataFrame:
            named = [r.win for r in some.select("win").limit(most + 1).collect()]
            return blocks.where(F.col("win").isin(named)) if len(named) <= most else blocks.join(some.select("win"), "win", "left_semi")

        probes = windows.orderBy(F.desc("bound"), "win").limit(PROBES).collect()
        if not probes:
            return Best(none.rows, total, 0)
        first = scored(blocks.where(F.col("win").isin([r.win for r in probes]))).orderBy("rank", "id").limit(k).collect()
        read = sum(r.blocks for r in probes)
        known = self.store.spark.createDataFrame(first, "id long, rank double")
        rest = windows.where(~F.col("win").isin([r.win for r in probes]))
        if len(first) == k:
            rest = rest.where(F.col("bound") >= -first[-1].rank * SLACK)
        more = rest.agg(F.sum("blocks")).first()[0] or 0
        rows = known if not more else known.unionByName(scored(within(rest, MOST_WINDOWS)))
        return Best(rows.orderBy("rank", "id").limit(k), total, read + more)


class KeywordIndex:
    """Segments, commits and removals below ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, window: int = WINDOW) -> None:
        self.spark, self.root, self.buckets, self.window = spark, root.rstrip("/"), buckets, window

    @classmethod
    def create(cls, spark: SparkSession, root: str, buckets: int = BUCKETS, window: int = WINDOW) -> KeywordIndex:
        """Lay out empty tables; existing ones are kept, and refuse another layout than their own."""
        index = cls(spark, root, buckets, window)
        for name, schema in (("commits", COMMITS), ("removed", REMOVED)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(index._path(name))
        for name, schema in (("postings", BLOCKS), ("words", WORDS), ("sizes", SIZES)):
            empty = spark.createDataFrame([], schema).drop("segment", "bucket")
            inner = "/bucket=0" if name == "postings" else ""
            empty.write.mode("ignore").parquet(f"{index._path(name)}/segment=__none__{inner}")
        layout = "buckets INT, window INT"
        spark.createDataFrame([(buckets, window)], layout).coalesce(1).write.mode("ignore").parquet(index._path("layout"))
        held = spark.read.schema(layout).parquet(index._path("layout")).first()
        if (held.buckets, held.window) != (buckets, window):
            raise ConfigurationError(f"the index has {held.buckets} buckets and windows of {held.window} ids")
        return index

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def bucket(self, word: str) -> int:
        return zlib.crc32(word.encode()) % self.buckets

    def _commits(self) -> list:
        return self.spark.read.schema(COMMITS).parquet(self._path("commits")).dropDuplicates(["segment"]).orderBy("no").collect()

    def segments(self) -> list:
        """Committed segments that no other has replaced."""
        all_of = self._commits()
        gone = {s for c in all_of for s in c.replaces}
        return [c for c in all_of if c.segment not in gone]

    def open(self) -> Opened:
        live = self.segments()
        removed = self.spark.read.schema(REMOVED).parquet(self._path("removed")).where(F.col("no").isin([s.no for s in live]))
        less = removed.agg(F.count("*").alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("d")).first()
        return Opened(self, tuple(live), sum(s.articles for s in live) - less.n, sum(s.words for s in live) - less.d, removed if less.n else None)

    def add(self, segment: str, articles: DataFrame) -> bool:
        """Index a batch of articles that the index does not hold yet; False if its segment is committed."""
        found = K.entries(articles)
        sizes = K.split_words(articles).select("id", "d")
        return self._store(segment, found, sizes, [])

    def remove(self, ids: DataFrame) -> None:
        """Take articles out by id; unknown ids are ignored. A changed article is removed and added with a later segment."""
        now = self.open()
        held = now._live("sizes", SIZES).join(ids.select("id").distinct(), "id", "left_semi").select("id", "no", "d")
        if now.removed is not None:
            held = held.join(now.removed.select("id", "no"), ["id", "no"], "left_anti")
        held.write.mode("append").parquet(self._path("removed"))

    def compact(self, segment: str, replaces: Sequence[str] | None = None) -> bool:
        """Write several segments (all, if not named) as one, without removed articles."""
        now = self.open()
        chosen = [s for s in now.segments if replaces is None or s.segment in replaces]
        some = Opened(self, tuple(chosen), 0, 0, now.removed)
        found = some.entries(some._live("postings", BLOCKS)).select("id", "d", "gap_1", "gap_2", "token", "places")
        sizes = some._live("sizes", SIZES).select("id", "no", "d")
        if now.removed is not None:
            sizes = sizes.join(now.removed.select("id", "no"), ["id", "no"], "left_anti")
        return self._store(segment, found, sizes.select("id", "d"), [s.segment for s in chosen])

    def _store(self, segment: str, found: DataFrame, sizes: DataFrame, replaces: list[str]) -> bool:
        before = self._commits()
        if any(c.segment == segment for c in before):
            return False
        no = max((c.no for c in before), default=0) + 1

        def write(rows: DataFrame, table: str, schema: str) -> DataFrame:
            part = f"{self._path(table)}/segment={segment}"
            out = rows.withColumn("no", F.lit(no))
            (out.write.partitionBy("bucket") if "bucket" in out.columns else out.write).mode("overwrite").parquet(part)
            return self.spark.read.schema(schema).option("basePath", self._path(table)).parquet(part)

        win = F.floor(F.col("id") / self.window)
        bucket = F.pmod(F.crc32(F.col("token").cast("binary")), F.lit(self.buckets)).cast("int")
        # dealt out once: the blocks of a word and span meet in one task, and so does nothing larger
        dealt = found.withColumns({"bucket": bucket, "win": win}).withColumn("span", F.floor(F.col("win") / SPAN)).repartition("bucket", "span")
        blocks = dealt.groupBy("bucket", "span", "token", "win").agg(
            F.count("*").alias("n"), F.max(F.size("places")).alias("most"), F.min("d").alias("least_d"),
            F.sort_array(F.collect_list(F.struct("id", "d", "gap_1", "gap_2", "places"))).alias("entries"))
        written = write(blocks.drop("span").sortWithinPartitions("bucket", "token", "win"), "postings", BLOCKS)
        named = written.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"))
        write(named.repartitionByRange("token").sortWithinPartitions("token"), "words", WORDS)
        counted = write(sizes, "sizes", SIZES).agg(F.count("*").alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("d")).first()
        self.spark.createDataFrame([(segment, no, counted.n, counted.d, replaces)], COMMITS).coalesce(1).write.mode("append").parquet(self._path("commits"))
        return True
