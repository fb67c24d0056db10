"""The vector table: checks, upsert, delete and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import EmbeddingMismatch
from ..runtime import Scratch

# Queries held by every task at once. A block of 4096 queries with 384
# dimensions is 12 MB; more queries are answered by a grid.
BLOCK_QUERIES = 4096
CHUNK_BYTES = 64 << 20  # vectors that one task of the grid holds, as doubles
_STRIPE = 128  # queries multiplied with one Arrow batch at a time
METRICS = ("cosine", "l2sq")


def violations(vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """Rows whose model or number of dimensions is not the configured one."""
    return vectors.where(
        F.col("embedding").isNull() | (F.size("embedding") != dim) | ~F.col("embed_model").eqNullSafe(model)
    )


def check_vectors(vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """The table itself; raises when a row breaks the model lock."""
    for row in violations(vectors, model, dim).select("id").limit(1).collect():
        raise EmbeddingMismatch(f"vector {row.id} is not from {model!r} with {dim} dimensions")
    return vectors


def latest_by_id(rows: DataFrame, order: str) -> DataFrame:
    """One row per id: that with the largest ``order``; of equal ones the largest row, so the choice never varies."""
    others = [c for c in rows.columns if c not in ("id", order)]
    row = F.struct(order, *others)
    return rows.groupBy("id").agg(F.max(row).alias("r")).select("id", "r.*").select(*rows.columns)


def upsert(stored: DataFrame, new: DataFrame, order: str, dim: int | None = None) -> DataFrame:
    """Stored rows with ``new`` put in by id; of several new rows the last wins.

    New rows of one id are combined before the shuffle. Stored rows are not
    sorted or regrouped: those without a new version pass through. A new row without
    ``dim`` dimensions fails the job.
    """
    columns = stored.columns
    if dim is not None:
        wrong = F.raise_error(F.concat(F.lit("EmbeddingMismatch: vector "), F.col("id").cast("string"))).cast(new.schema["embedding"].dataType)
        new = new.withColumn("embedding", F.when(F.coalesce(F.size("embedding"), F.lit(0)) == dim, F.col("embedding")).otherwise(wrong))
    latest = latest_by_id(new.select(*dict.fromkeys([*columns, order])), order)
    return stored.join(latest.select("id"), "id", "left_anti").unionByName(latest.select(*columns))


def delete(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids.select("id").distinct(), "id", "left_anti")


def place_filter(country: str | None = None, language: str | None = None) -> Column | None:
    """Equality on what is given; an empty text counts as not given."""
    wanted = {"country": country, "language": language}
    clause = None
    for name, value in wanted.items():
        if value:
            test = F.col(name) == value
            clause = test if clause is None else clause & test
    return clause


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k per row by score, then by smaller id."""
    if scores.shape[1] > k:
        # Everything not worse than the k-th best, so that ties go by id.
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        width = int((scores >= floor[:, None]).sum(axis=1).max())
        pick = np.argpartition(-scores, min(width, scores.shape[1]) - 1, axis=1)[:, :width]
        scores, ids = np.take_along_axis(scores, pick, 1), np.take_along_axis(ids, pick, 1)
    best = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)


def _similarity(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    dots = queries @ rows.T
    row_sq, query_sq = (rows * rows).sum(axis=1), (queries * queries).sum(axis=1)
    if metric == "l2sq":
        return 1.0 - (row_sq[None, :] + query_sq[:, None] - 2.0 * dots)
    norms = np.sqrt(query_sq)[:, None] * np.sqrt(row_sq)[None, :]
    return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)


def _partial_top(
    vectors: DataFrame, query_ids: list, queries: np.ndarray, query_type: str, k: int, metric: str
) -> DataFrame:
    """Every partition's k best rows per query, as (query_id, id, similarity).

    A task keeps k candidates per query while its Arrow batches pass, so what
    is shuffled does not grow with the rows of a partition.
    """
    dim = queries.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(queries)
        scores, ids = np.empty((count, 0)), np.empty((count, 0), dtype="int64")
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("embedding")
            flat = column.flatten().to_numpy(zero_copy_only=False)
            if len(flat) != batch.num_rows * dim:
                raise EmbeddingMismatch(f"a stored vector does not have {dim} dimensions")
            rows = flat.reshape(-1, dim).astype("float64")
            row_ids = batch.column("id").to_numpy(zero_copy_only=False)
            kept = []
            for at in range(0, count, _STRIPE):
                part = slice(at, at + _STRIPE)
                now = _similarity(rows, queries[part], metric)
                now_ids = np.broadcast_to(row_ids, now.shape)
                kept.append(_top(np.hstack([scores[part], now]), np.hstack([ids[part], now_ids]), k))
            scores = np.vstack([s for s, _ in kept])
            ids = np.vstack([i for _, i in kept])
        width = scores.shape[1]
        if width:
            index = np.repeat(np.arange(count), width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(index), pa.array(ids.ravel()), pa.array(scores.ravel())],
                names=["query_no", "id", "similarity"],
            )

    found = vectors.select("id", "embedding").mapInArrow(scan, "query_no bigint, id bigint, similarity double")
    names = F.array(*[F.lit(q) for q in query_ids]) if len(query_ids) <= 64 else None
    if names is not None:
        return found.select(
            F.element_at(names, (F.col("query_no") + 1).cast("int")).cast(query_type).alias("query_id"), "id", "similarity"
        )
    spark = vectors.sparkSession
    lookup = spark.createDataFrame(list(enumerate(query_ids)), f"query_no bigint, query_id {query_type}")
    return found.join(F.broadcast(lookup), "query_no").select("query_id", "id", "similarity")


def check_length(query: Sequence[float], dim: int | None) -> None:
    if dim is not None and len(query) != dim:
        raise EmbeddingMismatch(f"the query has {len(query)} dimensions, the stored vectors have {dim}")


def nearest(
    vectors: DataFrame,
    query: Sequence[float],
    k: int = 10,
    country: str | None = None,
    language: str | None = None,
    metric: str = "cosine",
    dim: int | None = None,
) -> DataFrame:
    """The k most similar rows as (id, similarity), best first.

    ``dim``: the dimension of the stored model; another query length is refused before any job.

    Filters reach the scan; similarity is 1 - distance, for unit vectors the
    dot product (cosine) or twice that minus one (l2sq).
    """
    if metric not in METRICS:
        raise EmbeddingMismatch(f"metric must be one of {METRICS}")
    check_length(query, dim)
    clause = place_filter(country, language)
    rows = vectors if clause is None else vectors.where(clause)
    found = _partial_top(rows, [0], np.asarray([query], dtype="float64"), "int", k, metric)
    return found.select("id", "similarity").orderBy(F.desc("similarity"), "id").limit(k)


def nearest_batch(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    scratch: Scratch,
    metric: str = "cosine",
    block_queries: int = BLOCK_QUERIES,
    chunk_bytes: int = CHUNK_BYTES,
    dim: int | None = None,
) -> DataFrame:
    """k most similar rows for each (query_id, embedding), with their place.

    ``dim``: the dimension of the stored model; a query of another length is refused before the vectors are read.
    One block of queries travels to the vectors, which stay where they are. More queries are answered in one job by a
    grid: vectors are dealt into chunks that fit a task, every query visits every chunk, and a task keeps
    k rows per query, which are then merged. No number of queries adds a pass or a job.
    """
    if metric not in METRICS:
        raise EmbeddingMismatch(f"metric must be one of {METRICS}")
    wanted = scratch.cut(queries.select("query_id", "embedding"), "queries")
    if dim is not None:
        check_queries(wanted, dim)
    query_type = wanted.schema["query_id"].dataType.simpleString()
    number = wanted.count()
    if number <= block_queries:
        return _best(_block_top(vectors, wanted, query_type, k, metric), k)
    dim = dim or wanted.agg(F.max(F.size("embedding"))).first()[0]
    stored = scratch.cut(vectors.select("id", "embedding"), "vectors")
    chunks = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-stored.count() * dim * 8 // chunk_bytes))
    rows = stored.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn("kind", F.lit(0))
    visits = wanted.select("query_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(1).alias("kind"))
    grid = rows.unionByName(visits, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "kind")
    return _best(grid.mapInArrow(_grid_top(k, dim, metric), f"query_id {query_type}, id bigint, similarity double"), k)


def check_queries(queries: DataFrame, dim: int) -> None:
    """Raise unless every query has the dimension of the stored model."""
    for row in queries.where(F.coalesce(F.size("embedding"), F.lit(0)) != dim).select("query_id", F.size("embedding").alias("n")).limit(1).collect():
        raise EmbeddingMismatch(f"query {row.query_id!r} has {row.n} dimensions, the stored vectors have {dim}")


def _matrix(column: pa.Array, count: int, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != count * dim:
        raise EmbeddingMismatch(f"a vector does not have {dim} dimensions")
    return flat.reshape(-1, dim).astype("float64")


def _grid_top(k: int, dim: int, metric: str):
    """The k best rows of each chunk for every query, from a stream with a chunk's vectors before its visits."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, held, rows, ids = None, [], [], None, None
        for batch in batches:
            places = batch.column("chunk").to_numpy() * 2 + batch.column("kind").to_numpy()
            borders = [0, *(np.flatnonzero(places[1:] != places[:-1]) + 1).tolist(), len(places)]
            for i, j in zip(borders, borders[1:]):
                if i == j:
                    continue
                part, place = batch.slice(i, j - i), int(places[i])
                if place // 2 != chunk:
                    chunk, parts, held, rows = place // 2, [], [], None
                if place % 2 == 0:
                    parts.append(_matrix(part.column("embedding"), j - i, dim))
                    held.append(part.column("id").to_numpy())
                    continue
                if not parts:
                    continue  # a chunk without vectors
                if rows is None:
                    rows, ids = np.vstack(parts), np.concatenate(held)
                queries = _matrix(part.column("embedding"), j - i, dim)
                for at in range(0, j - i, _STRIPE):
                    now = _similarity(rows, queries[at:at + _STRIPE], metric)
                    best, best_ids = _top(now, np.broadcast_to(ids, now.shape), k)
                    index = np.repeat(np.arange(at, at + len(now)), best.shape[1])
                    yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(index)), pa.array(best_ids.ravel()), pa.array(best.ravel())],
                                                     names=["query_id", "id", "similarity"])

    return scan


def _block_top(vectors: DataFrame, block: DataFrame, query_type: str, k: int, metric: str) -> DataFrame:
    rows = block.select("query_id", "embedding").collect()  # at most one block
    if not rows:
        return vectors.sparkSession.createDataFrame([], f"query_id {query_type}, id bigint, similarity double")
    matrix = np.asarray([r.embedding for r in rows], dtype="float64")
    return _partial_top(vectors, [r.query_id for r in rows], matrix, query_type, k, metric)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
