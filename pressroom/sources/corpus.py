"""The stored corpus: Parquet tables of batches, visible once committed.

A batch writes its part of every table below ``batch=<id>`` and then appends
one commit row. Readers keep committed batches only, so a half-written batch
is never seen and its rerun simply writes the same folders again.

The run log is not part of that: it is appended to before and after the work, so
a run that fails leaves its opening entry. Vectors can be put in and taken out
after their batch: such changes are numbered and read over the batches' rows, until
``fold_vectors`` writes the batches they touch anew.
The corpus is locked to the embedding model it was first used with.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Settings
from ..errors import EmbeddingMismatch
from ..operators.crawl import latest_runs
from ..operators.segments import KeywordIndex, Opened
from ..operators.timeline import daily_parts, is_day, stamped, timeline, timeline_of_parts
from ..operators.vectors import latest_by_id
from ..runtime import Scratch
from ..schema import ARTICLES, CHANGES, COMMITS, CRAWL_RUNS, DAILY, FOLDS, MODEL, REMOVALS, SIGHTINGS, VECTORS

TABLES = {
    "articles": ARTICLES,
    "vectors": VECTORS,
    "sightings": SIGHTINGS,
    "daily": DAILY,
}


Part = DataFrame | Callable[[dict[str, DataFrame]], DataFrame]


class Corpus:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, root: str, settings: Settings | None = None) -> Corpus:
        """Lay out empty tables; existing ones are kept. ``settings`` checks the model, or sets it in a new corpus."""
        corpus = cls(spark, root)
        for name, schema in TABLES.items():
            corpus._empty(schema).write.mode("ignore").parquet(f"{corpus._path(name)}/batch=__none__")
        for name, schema in (("commits", COMMITS), ("run_log", CRAWL_RUNS), ("model", MODEL), ("vector_changes", CHANGES), ("vector_folds", FOLDS), ("article_removals", REMOVALS)):
            corpus._empty(schema).write.mode("ignore").parquet(corpus._path(name))
        if settings is not None:
            corpus.check_model(settings.embed_model, settings.embed_dim)
        return corpus

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def commits_path(self) -> str:
        return self._path("commits")

    def daily_of(self, batches: list[str]) -> DataFrame:
        """Daily counts that came with the given committed batches."""
        return self._stored("daily").where(F.col("batch").isin(batches)).drop("batch")

    def commits(self) -> DataFrame:
        return self.spark.read.schema(COMMITS).parquet(self._path("commits")).dropDuplicates(["batch"])

    def check_model(self, model: str, dim: int) -> None:
        """Raise unless the corpus holds vectors of this model and dimension; a corpus without one takes it."""
        held = self.spark.read.schema(MODEL).parquet(self._path("model")).first()
        if held is None:
            self.spark.createDataFrame([(model, dim)], MODEL).coalesce(1).write.mode("append").parquet(self._path("model"))
        elif (held.embed_model, held.embed_dim) != (model, dim):
            raise EmbeddingMismatch(f"the corpus holds {held.embed_model!r} with {held.embed_dim} dimensions, not {model!r} with {dim}")

    def dim(self) -> int | None:
        """Dimension of the stored vectors, which search calls hand on; None before the first use."""
        held = self.spark.read.schema(MODEL).parquet(self._path("model")).first()
        return held.embed_dim if held else None

    def search(self, text: str, embed_query: Callable[[str], list[float]], as_of: str, **options) -> DataFrame:
        """``operators.search.search`` over what is stored, with its keyword index and its model's dimension."""
        from ..operators.search import search  # search reads corpora, this module stores them

        return search(text, self.read("vectors"), self.read("articles"), self.keyword_index, embed_query, as_of, dim=self.dim(), **options)

    def is_committed(self, batch: str) -> bool:
        return not self.commits().where(F.col("batch") == batch).isEmpty()

    def log_runs(self, entries: DataFrame) -> None:
        """Append entries to the run log; they are visible at once."""
        entries.select(*self._empty(CRAWL_RUNS).columns).write.mode("append").parquet(self._path("run_log"))

    def runs(self, batch: str | None = None) -> DataFrame:
        """The latest entry of each run, of one batch or all."""
        log = self.spark.read.schema(CRAWL_RUNS).parquet(self._path("run_log"))
        return latest_runs(log if batch is None else log.where(F.col("run_id").startswith(f"{batch}/")))

    def put_vectors(self, rows: DataFrame) -> None:
        """Insert or replace stored vectors by id; of several rows of one id the one with the largest embedding wins."""
        held = self.spark.read.schema(MODEL).parquet(self._path("model")).first()
        if held is not None:
            right = (F.size("embedding") == held.embed_dim) & F.col("embed_model").eqNullSafe(held.embed_model)
            wrong = F.raise_error(F.concat(F.lit("EmbeddingMismatch: vector "), F.col("id").cast("string"))).cast("boolean")
            rows = rows.withColumn("deleted", F.when(F.coalesce(right, F.lit(False)), False).otherwise(wrong))
        else:
            rows = rows.withColumn("deleted", F.lit(False))
        self._change(rows)

    def delete_vectors(self, ids: DataFrame) -> None:
        """Take stored vectors out by id; unknown ids are ignored."""
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self._empty(VECTORS).schema if f.name != "id"]
        self._change(ids.select("id").distinct().select("id", *empty, F.lit(True).alias("deleted")))

    def fold_vectors(self) -> int:
        """Write the batches that changes have touched anew, changes worked in; the number of batches written or emptied.

        Batches without a change stay as they are. New folders count, and old ones and the changes cease to, with the one
        row that ends the fold, so a fold that fails leaves all as it was and readers see one state or the other. Ids that no
        batch holds get a folder of their own. Changes made meanwhile stay for the next fold.
        """
        folded = self._folded()
        pending = self._changes(folded)
        through = pending.agg(F.max("change")).first()[0]
        if through is None:
            return 0
        with Scratch(self.spark, "fold") as scratch:
            changes = scratch.cut(latest_by_id(pending.where(F.col("change") <= through), "change"), "changes")
            live = self._live("vectors")
            homes = scratch.cut(live.select("id", "batch").join(changes.select("id"), "id", "left_semi"), "homes")
            touched = homes.select("batch").distinct()
            name = f"{through}-{uuid.uuid4().hex}"
            kept = live.join(touched, "batch", "left_semi").join(changes.select("id"), "id", "left_anti")
            put = changes.where("not deleted").join(homes.groupBy("id").agg(F.min("batch").alias("batch")), "id", "left").withColumn("batch", F.coalesce("batch", F.lit("put")))
            columns = [f.name for f in self._empty(VECTORS).schema]
            rows = kept.select(*columns, "batch").unionByName(put.select(*columns, "batch"))
            rows.withColumn("batch", F.concat(F.split("batch", "~")[0], F.lit(f"~{name}"))).write.partitionBy("batch").mode("append").parquet(self._path("vectors"))
            written = self._stored("vectors").where(F.endswith("batch", F.lit(f"~{name}"))).select("batch").distinct()
            both = touched.select(F.col("batch").alias("replaced"), F.lit(None).cast("string").alias("written")).unionByName(
                written.select(F.lit(None).cast("string").alias("replaced"), F.col("batch").alias("written")))
            entry = both.agg(F.collect_list("replaced").alias("replaced"), F.collect_list("written").alias("written"))
            entry = entry.select(F.lit(through).cast("bigint").alias("through"), "replaced", "written")
            entry.coalesce(1).write.mode("append").parquet(self._path("vector_folds"))
            return touched.count()

    def remove_articles(self, ids: DataFrame) -> None:
        """Take stored articles out by id, with their vectors; unknown ids are ignored. The sighting ledger keeps their keys."""
        gone = self.read("articles").join(ids.select("id").distinct(), "id", "left_semi")
        gone.select("id", "topic", stamped().cast("date").alias("day")).write.mode("append").parquet(self._path("article_removals"))
        self.delete_vectors(ids)

    def daily(self) -> DataFrame:
        """Daily counts of what is stored, from the parts that came with each batch; articles are not read."""
        less = self._removals().where("day is not null").groupBy("topic", "day").agg((-F.count("*")).alias("articles"))
        return self.read("daily").unionByName(less)

    def timeline(self, topic: str | None = None, days: int | None = None, start: str | None = None, end: str | None = None, as_of: str | None = None) -> DataFrame:
        """Articles per day; bounds inside a day need the articles, whole days only their counts."""
        if is_day(start) and is_day(end):
            return timeline_of_parts(self.daily(), topic, days, start, end, as_of)
        return timeline(self.read("articles"), topic, days, start, end, as_of)

    def keyword_index(self) -> Opened:
        """The keyword index of what is stored now: batches it does not hold are added, removed articles taken out."""
        index = KeywordIndex.create(self.spark, f"{self.root}/keyword")
        held = {c.segment for c in index.segments()} | {s for c in index.segments() for s in c.replaces}
        for row in self.commits().where("articles > 0").orderBy("max_id").collect():
            if row.batch not in held:
                index.add(row.batch, self._stored("articles").where(F.col("batch") == row.batch))
        gone = self._removals()
        if not gone.isEmpty():
            index.remove(gone)
        return index.open()

    def _removals(self) -> DataFrame:
        return self.spark.read.schema(REMOVALS).parquet(self._path("article_removals")).dropDuplicates(["id"])

    def _change(self, rows: DataFrame) -> None:
        last = self.spark.read.schema(CHANGES).parquet(self._path("vector_changes")).agg(F.max("change")).first()[0] or 0
        numbered = rows.withColumn("change", F.lit(last + 1).cast("bigint"))
        numbered.select(*self._empty(CHANGES).columns).write.mode("append").parquet(self._path("vector_changes"))

    def _folds(self) -> DataFrame:
        return self.spark.read.schema(FOLDS).parquet(self._path("vector_folds"))

    def _folded(self) -> int:
        """The last change that is part of the stored batches."""
        return self._folds().agg(F.max("through")).first()[0] or 0

    def _changes(self, after: int) -> DataFrame:
        return self.spark.read.schema(CHANGES).parquet(self._path("vector_changes")).where(F.col("change") > after)

    def _live(self, table: str) -> DataFrame:
        """Rows of a table in folders that count, with their ``batch``: committed ones, and for vectors those of folds."""
        batches = self.commits().select("batch")
        if table == "vectors":
            told = lambda c: self._folds().select(F.explode(c).alias("batch"))
            batches = batches.unionByName(told("written")).join(told("replaced"), "batch", "left_anti")
        return self._stored(table).join(batches, "batch", "left_semi")

    def next_id(self) -> int:
        return (self.commits().agg(F.max("max_id")).first()[0] or 0) + 1

    def read(self, table: str) -> DataFrame:
        """All committed rows of a table; folders of other batches are pruned by the join with the commits."""
        rows = self._live(table).drop("batch")
        if table == "articles":
            return rows.join(self._removals().select("id"), "id", "left_anti")
        if table != "vectors":
            return rows
        changes = latest_by_id(self._changes(self._folded()), "change")
        kept = rows.join(changes.select("id"), "id", "left_anti")
        return kept.unionByName(changes.where("not deleted").select(*rows.columns))

    def _stored(self, table: str) -> DataFrame:
        return self.spark.read.schema(f"{TABLES[table]}, batch STRING").parquet(self._path(table))

    def publish(self, batch: str, tables: dict[str, Part]) -> bool:
        """Store a batch and commit it; False if it was committed before.

        A table is given as rows, or as a function of the parts written so far,
        so that later tables can be built from stored rows of earlier ones.
        """
        if self.is_committed(batch):
            return False
        written: dict[str, DataFrame] = {}
        for name, schema in TABLES.items():
            part = tables.get(name)
            if part is None and name == "daily":
                part = daily_parts(written["articles"])
            if callable(part):
                part = part(written)
            part = self._empty(schema) if part is None else part.select(*self._empty(schema).columns)
            where = f"{self._path(name)}/batch={batch}"
            part.write.mode("overwrite").parquet(where)
            written[name] = self.spark.read.schema(schema).parquet(where)
        commit = written["articles"].agg(F.count("*").alias("articles"), F.max("id").alias("max_id"))
        highest = F.coalesce("max_id", F.lit(self.next_id() - 1)).alias("max_id")
        commit.select(F.lit(batch).alias("batch"), "articles", highest).write.mode("append").parquet(
            self._path("commits")
        )
        return True


def export(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write any result as files of the given format."""
    df.write.mode("errorifexists").format(fmt).save(path)


def as_json(df: DataFrame, out: str = "json") -> DataFrame:
    """One JSON object per row, nulls kept as null."""
    everything = F.struct(*[F.col(c) for c in df.columns])
    return df.select(F.to_json(everything, {"ignoreNullFields": "false"}).alias(out))
