import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pressroom.llm import ns_kmeans
from pressroom.llm.oracles import ORACLE
from pressroom.llm.queries import QUERIES
from tests.compare import connect, differences


def brute(rows, clusters, rounds, dims, seed=2):
    """The definition, in whole numbers: sorted rows (vec_id, cluster, distance, cluster inertia, inertia, digest)."""
    kept = [(i, [max(-2**27, min(2**27, math.floor(256 * x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: ("~",) if i is None else (hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(),)
    kind = np.int16
    first = sorted(kept, key=lambda r: (digest(r[0]), np.array(r[1], kind if max(map(abs, r[1])) < 1 << 15 else np.int32).tobytes()))[:clusters]
    centroids = [v for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j))
    for _ in range(rounds):
        parts = {}
        for _, v in kept:
            parts.setdefault(nearest(v), []).append(v)
        centroids = [[sum(x) // len(parts[j]) for x in zip(*parts[j])] if j in parts else c for j, c in enumerate(centroids)]
    placed = [(i, j, far(v, centroids[j])) for i, v in kept for j in [nearest(v)]]
    own = {j: sum(d for _, k, d in placed if k == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, own[j], sum(own.values()), sha[j]) for i, j, d in placed), key=str)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 12), st.integers(1, 4), st.integers(1, 40), st.integers(1, 6))
def test_bounds_never_change_an_assignment(seed, k, group, spread, rounds):
    """Centroids that wander anywhere, near and far: the bounded assignment equals the full scan, ties included."""
    rng = np.random.default_rng(seed)
    q = rng.integers(-spread, spread, (120, 3))
    history, state = [], None
    at = rng.integers(-spread, spread, (k, 3))
    for _ in range(rounds):
        history = [*history, at]
        state = ns_kmeans.assign(q, state, history, group)
        full = ((q[:, None] - at[None]) ** 2).sum(2)
        assert (state[0] == full.argmin(1)).all()
        at = at + rng.integers(-3, 4, (k, 3)) * rng.integers(0, 2, (k, 1))


def test_displacement_is_of_the_whole_way():
    there, back = np.array([[0, 0], [9, 9]]), np.array([[30, 40], [9, 9]])
    norms, most = ns_kmeans.moved([there, back, there], 1)
    assert norms[0].tolist() == [0, 0] and norms[1].tolist() == [50, 0] and most[1].tolist() == [50, 0]


def test_bounds_save_work():
    rng = np.random.default_rng(3)
    at = rng.integers(-1000, 1000, (20, 8))
    q = np.concatenate([c + rng.integers(-5, 6, (50, 8)) for c in at])
    state = ns_kmeans.assign(q, None, [at])
    again = ns_kmeans.assign(q, state, [at, at + 1])
    assert (again[2] == 0).all() and (again[4] == 0).all()  # nothing was evaluated again


def test_squared_is_exact_for_large_components():
    q = np.array([[2**27, -2**27] * 32, [2**22 - 1] * 64])
    c = np.array([[-2**27, 2**27] * 32, [-2**22] * 64])
    assert ns_kmeans.squared(q, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in q]


NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    out = [(int(i), [round(float(x), 2) for x in rng.normal(0, 0.1 + (i % 4), 4)]) for i in range(120)]
    out += [(200, None), (201, []), (202, [1.0, 2.0]), (203, [1.0, None, 2.0, 3.0]), (204, [NAN, 0.0, 0.0, 0.0]), (205, [INF, 0.0, 0.0, 0.0]), (206, [0.0] * 5)]
    out += [(5, [0.25, 0.25, 0.25, 0.25])] * 3 + [(None, [0.5, 0.5, 0.5, 0.5]), (None, [0.5, 0.5, 0.5, 0.5]), (-9, [-0.001, 0.0, 0.001, 1.0]), (207, [1e30, -1e30, 300.0, 0.0])]
    return out + [(300 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(60)]


SCHEMA = "vec_id long, embedding array<double>, cluster string, q int, distance string, part_of int"


@pytest.mark.parametrize("clusters, rounds, parts", [(7, 3, 1), (12, 5, 4), (40, 2, 8), (500, 1, 2), (3, 0, 3)])
def test_against_brute_force(spark, rows, clusters, rounds, parts):
    table = spark.createDataFrame([(i, v, "x", 1, "y", 2) for i, v in rows], SCHEMA).repartition(parts)
    got = ns_kmeans.clustered(table, clusters, rounds, dims=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, clusters, rounds, 4)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ns_kmeans.clustered(none).collect() == []
    assert ns_kmeans.clustered(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).collect() == []


def test_sql(spark, sf_dir):
    assert differences(spark, connect(sf_dir), sf_dir, QUERIES["op11_ns_kmeans"], ORACLE["op11_ns_kmeans"]) is None
