"""Exact k-means on integer vectors with ns-bounds.

Each vector keeps its cluster, an upper bound of the distance to its centroid and, for each group of
centroids, a lower bound of the distance to the others, with the round in which each was last evaluated.
The centroids of all rounds are retained: a bound of round r is loosened by the norm of the whole
displacement between the centroid of round r and that of now, max over the group, which is at most the sum
of the drifts of single rounds. Where an upper bound no longer lies strictly below a lower one, the upper
bound is evaluated; where that fails too, the failing groups are scanned in exact integer arithmetic, so
that ties go to the smaller number.

A round is one pass over the vectors in Arrow batches: each task writes the new state of its vectors and
one row of exact sums per cluster. What goes to tasks is the history (rounds x clusters x dimensions), what
comes back one row per cluster and dimension. A round's table is deleted when the next is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..runtime import Scratch, spread

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SEED = 2
SCALE = 256
GROUP = 5  # centroids that share a lower bound
LARGEST = 1 << 27  # with it, squared distances of 64 components fit a long
EXACT = 1 << 23  # up to here sums of squares are whole numbers in double precision
SLACK = 1e-9  # relative; far above the rounding of a root and a sum

STATE = "vec_id long, q binary, cluster int, upper double, upper_at int, lower binary, lower_at binary, distance long"
SUMS = "part_of int, n long, sums array<long>, inertia decimal(38,0)"


def _integers(batch: pa.RecordBatch, dims: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows with exactly ``dims`` finite components, and floor(SCALE * x) of them."""
    column = batch.column("embedding")
    sized = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    batch = batch.filter(sized)
    values = batch.column("embedding").flatten()
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # a null is NaN
    whole = np.isfinite(flat).all(1)
    with np.errstate(over="ignore"):
        q = np.clip(np.floor(flat[whole] * SCALE), -LARGEST, LARGEST).astype(np.int64)
    return batch.filter(pa.array(whole)), q


def _pack(q: np.ndarray) -> list[bytes]:
    kind = np.int16 if not len(q) or np.abs(q).max() < 1 << 15 else np.int32
    return [row.tobytes() for row in q.astype(kind)]


def _unpack(column: pa.Array, dims: int) -> np.ndarray:
    out = np.empty((len(column), dims), np.int64)
    blobs = column.to_pylist()
    size = np.array([len(b) for b in blobs]) // dims
    for kind in (np.int16, np.int32):
        some = np.flatnonzero(size == np.dtype(kind).itemsize)
        if len(some):
            out[some] = np.frombuffer(b"".join([blobs[i] for i in some.tolist()]), kind).reshape(-1, dims)
    return out


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of q to all rows of c."""
    if max(np.abs(q).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
        a, b = q.astype(np.float64), c.astype(np.float64)
        # three whole numbers below 2^53 each, put together as integers
        return ((a * a).sum(1).astype(np.int64)[:, None] + (b * b).sum(1).astype(np.int64)[None]) - 2 * (a @ b.T).astype(np.int64)
    return np.stack([((q - row) ** 2).sum(1) for row in c], 1)


def own_squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of q to the same row of c."""
    return ((q - c) ** 2).sum(1)


def _vectors(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, q = _integers(batch, dims)
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), pa.array(_pack(q), pa.binary())], names=["vec_id", "q"])

    return run


def moved(history: list[np.ndarray], group: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
    """Norms of the displacement from each round's centroids to the last: [round, centroid] and the largest of each group."""
    now = history[-1]
    norms = np.stack([np.sqrt(own_squared(now, old).astype(np.float64)) for old in history])
    starts = np.arange(0, len(now), group)
    return norms, np.maximum.reduceat(norms, starts, axis=1)


def assign(q: np.ndarray, state: tuple | None, history: list[np.ndarray], group: int = GROUP) -> tuple:
    """(cluster, upper, upper_at, lower, lower_at) of vectors ``q`` under the last centroids of ``history``.

    ``state`` is the same tuple of an earlier round, or None for vectors that were never evaluated.
    """
    now, at = history[-1], len(history) - 1
    k, groups = len(now), -(-len(now) // group)
    if state is None:
        cluster, upper, upper_at = np.zeros(len(q), np.int64), np.zeros(len(q)), np.full(len(q), at)
        lower, lower_at = np.zeros((len(q), groups)), np.full((len(q), groups), at)
        todo, scan = np.arange(len(q)), np.ones((len(q), groups), bool)
    else:
        cluster, upper, upper_at, lower, lower_at = (x.copy() for x in state)
        norms, most = moved(history, group)
        loose = lower - most[lower_at, np.arange(groups)[None]]
        bound = loose.min(1)
        above = upper + norms[upper_at, cluster]
        some = np.flatnonzero(~(above * (1 + SLACK) < bound * (1 - SLACK)))
        upper[some] = np.sqrt(own_squared(q[some], now[cluster[some]]).astype(np.float64))
        upper_at[some] = at
        todo = some[~(upper[some] * (1 + SLACK) < bound[some] * (1 - SLACK))]
        scan = ~(upper[todo, None] * (1 + SLACK) < loose[todo] * (1 - SLACK))
        scan[np.arange(len(todo)), cluster[todo] // group] = True  # the group that loses or keeps its centroid
    if not len(todo):
        return cluster, upper, upper_at, lower, lower_at
    best, number = np.full(len(todo), np.iinfo(np.int64).max), np.full(len(todo), k)
    found = {}
    for f in range(groups):
        rows = np.flatnonzero(scan[:, f])
        if not len(rows):
            continue
        d = squared(q[todo[rows]], now[f * group:(f + 1) * group])
        found[f] = rows, d
        first = d.argmin(1)
        least = d[np.arange(len(rows)), first]
        wins = least < best[rows]  # groups come in ascending order, so a tie stays with the smaller number
        best[rows[wins]], number[rows[wins]] = least[wins], first[wins] + f * group
    cluster[todo], upper[todo], upper_at[todo] = number, np.sqrt(best.astype(np.float64)), at
    for f, (rows, d) in found.items():
        mine = np.flatnonzero(number[rows] // group == f)
        others = d.astype(np.float64)
        others[mine, number[rows[mine]] - f * group] = np.inf
        lower[todo[rows], f], lower_at[todo[rows], f] = np.sqrt(others.min(1)), at
    return cluster, upper, upper_at, lower, lower_at


def _round(shared, dims: int, first: bool, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history = shared.value
        now = history[-1]
        k, groups = len(now), -(-len(now) // GROUP)
        sums, counts, inertia = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), [0] * k
        for batch in batches:
            if not batch.num_rows:
                continue
            q, state = _unpack(batch.column("q"), dims), None
            if not first:
                lower = np.frombuffer(b"".join(batch.column("lower").to_pylist()), np.float64).reshape(-1, groups)
                lower_at = np.frombuffer(b"".join(batch.column("lower_at").to_pylist()), np.uint8).reshape(-1, groups).astype(np.int64)
                state = (*(batch.column(c).to_numpy().astype(t) for c, t in (("cluster", np.int64), ("upper", np.float64), ("upper_at", np.int64))), lower, lower_at)
            cluster, upper, upper_at, lower, lower_at = assign(q, state, history)
            np.add.at(sums, cluster, q)
            counts += np.bincount(cluster, minlength=k)
            distance = None
            if last:
                distance = own_squared(q, now[cluster])
                for c in np.unique(cluster).tolist():
                    inertia[c] += sum(distance[cluster == c].tolist())
            n = batch.num_rows
            empty = last  # the last round's bounds are never read
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), pa.nulls(n, pa.binary()) if empty else batch.column("q"), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(upper_at, pa.int32()),
                pa.nulls(n, pa.binary()) if empty else pa.array([x.tobytes() for x in lower], pa.binary()),
                pa.nulls(n, pa.binary()) if empty else pa.array([x.tobytes() for x in lower_at.astype(np.uint8)], pa.binary()),
                pa.nulls(n, pa.int64()) if distance is None else pa.array(distance),
                pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.decimal128(38, 0)),
            ], names=NAMES)
        some = np.flatnonzero(counts)
        if len(some):
            n = len(some)
            yield pa.RecordBatch.from_arrays([
                pa.nulls(n, t) for t in (pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
            ] + [pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64())),
                 pa.array([inertia[c] for c in some.tolist()], pa.decimal128(38, 0))], names=NAMES)

    return run


NAMES = [part.split(" ")[0] for part in f"{STATE}, {SUMS}".split(", ")]


def _means(sums: DataFrame, old: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of every cluster with vectors; the others stay."""
    held = sums.select("part_of", "n", F.posexplode("sums").alias("place", "part")).groupBy("part_of", "place").agg(
        F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    new = old.copy()
    for row in held.collect():  # clusters x dimensions rows
        new[row.part_of, row.place] = int(row.total) // row.n
    return new


def kmeans(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMENSIONS, seed: int = SEED, scratch: Scratch | None = None) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, cluster, distance) and the final centroids of ``vectors`` (vec_id, embedding).

    Vectors without exactly ``dims`` finite components are left out; components are floor(256 * x), held to +-2^27.
    Centroids start as the vectors with the smallest sha256 of "seed:vec_id"; vectors that repeat a vec_id follow each
    other by their components, those without one come last. With fewer vectors than ``clusters`` each is a centroid; an
    empty table gives no rows. Of equally near centroids the smaller number wins.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "kmeans")
    work = Scratch(spark, "kmeans-vectors")
    state = work.cut(spread(vectors.select("vec_id", "embedding")).mapInArrow(_vectors(dims), "vec_id long, q binary"), "vectors")
    start = state.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "q").limit(clusters)
    history = [_unpack(start.toArrow().column("q").combine_chunks(), dims)]
    if not len(history[0]):
        work.drop()
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), history[0]
    for at in range(rounds + 1):
        shared = spark.sparkContext.broadcast(history)
        last = at == rounds
        done = Scratch(spark, f"kmeans-{at}") if not last else scratch
        out = done.cut(state.mapInArrow(_round(shared, dims, at == 0, last), f"{STATE}, {SUMS}"), "state")
        work.drop()
        work, state = done, out.where("part_of is null").select(*NAMES[:8])
        if not last:
            history = [*history, _means(out.where("part_of is not null"), history[-1])]
    return out, history[-1]


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMENSIONS, seed: int = SEED, scratch: Scratch | None = None) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 (see ``kmeans``).

    Inertias are exact sums of squared distances; one that passes a long is null.
    """
    out, centroids = kmeans(vectors, clusters, rounds, dims, seed, scratch)
    rows = out.where("cluster is not null").select("vec_id", "cluster", "distance")
    if "part_of" not in out.columns:
        none = {"cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"), "centroid_sha256": F.lit("")}
        return rows.withColumns(none)
    parts = out.where("part_of is not null").groupBy("part_of").agg(F.sum("inertia").alias("x")).collect()  # a row per cluster
    total = sum(int(r.x) for r in parts)
    longs = lambda x: x if x < 1 << 63 else None
    facts = [(r.part_of, longs(int(r.x)), longs(total), hashlib.sha256(",".join(map(str, centroids[r.part_of].tolist())).encode()).hexdigest()) for r in parts]
    facts = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
