"""Connected components against union-find, with hubs that a third and more of all links share."""

import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from pressroom.operators import components as C, skew
from pressroom.runtime import Scratch


def union_find(links):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    return sorted((x, top(x)) for x in root)


def shapes():
    rng = random.Random(4)
    star = [(5000, i) for i in range(1, 400)] + [(i, 9000) for i in range(400, 700)]
    chain = [(10_000 + i, 10_001 + i) for i in range(120)]
    loose = [(rng.randint(20_000, 20_400), rng.randint(20_000, 20_400)) for _ in range(250)]
    bridge = [(5000, 10_050), (3, 3)]
    return {"star": star, "chain": chain, "loose": loose, "all": star + chain + loose + bridge + star[:50], "none": []}


@pytest.mark.parametrize("floor", [20_000, 10])
@pytest.mark.parametrize("shape", ["star", "all", "none"])
def test_components(spark, monkeypatch, shape, floor):
    monkeypatch.setattr(C, "FLOOR_LINKS", floor)
    links = shapes()[shape]
    rows = spark.createDataFrame(links, "a long, b long").repartition(4)
    assert sorted(map(tuple, C.components(rows, Scratch(spark)).collect())) == union_find(links)


def test_neighbours_of_a_hub_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(C, "FLOOR_LINKS", 1000)
    rows = Scratch(spark).cut(spark.range(5000).select(F.lit(7).cast("long").alias("a"), (F.col("id") + 10).alias("b")), "rows")
    low = rows.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
    joined = C._with_low(rows, low, 5000, Scratch(spark))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 3  # hot rows meet a broadcast; the anti-join leaves the others to the shuffle
    assert joined.count() == 5000


def test_core_queries_survive_a_missing_library():
    """Without a library that only the training-data operators need, the other queries are all there."""
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; from pressroom.contract.queries import QUERIES; assert set(e.queries()) == set(QUERIES), e.queries().keys()"
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_many_rows_are_not_broadcast_by_their_file_size(spark):
    # written keys compress to some kilobytes, far below what Spark broadcasts
    scratch = Scratch(spark, "test")
    unique = scratch.cut(spark.range(skew.BROADCAST_ROWS * 2).select(F.col("id").alias("k")), "unique")
    plan = lambda most: skew.join_unique(unique, unique, "k", None, "left_semi", most)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan(0) and "BroadcastExchange" in plan(skew.BROADCAST_ROWS)
    assert "BroadcastExchange" not in plan(skew.BROADCAST_ROWS * 2)
    assert skew.join_unique(unique, unique, "k", None, "left_semi", skew.BROADCAST_ROWS * 2).count() == skew.BROADCAST_ROWS * 2
