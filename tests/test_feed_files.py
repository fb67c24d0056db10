"""Feeds that queries write have as many files as their records need; results do not depend on it."""

from pyspark.sql import functions as F

from pressroom.contract import queries as Q
from pressroom.sources.derived import table


def test_feed_files_follow_the_records(spark, sf_dir, monkeypatch):
    records = table(spark, sf_dir, "documents").count()
    few = sorted(map(tuple, Q.QUERIES["feed_order"](spark, sf_dir).collect()))
    paths = []
    read, stream = Q.read_feed, Q.stream_feed
    monkeypatch.setattr(Q, "FILE_ROWS", records // 10)
    monkeypatch.setattr(Q, "read_feed", lambda spark, path, fmt: (paths.append(path), read(spark, path, fmt))[1])
    monkeypatch.setattr(Q, "stream_feed", lambda spark, path, fmt, **options: (paths.append(path), stream(spark, path, fmt, **options))[1])
    assert sorted(map(tuple, Q.QUERIES["feed_order"](spark, sf_dir).collect())) == few
    streamed = Q.QUERIES["streamed_ingest"](spark, sf_dir).select("id", "composite_key")
    assert sorted(map(tuple, streamed.collect())) == sorted((i, key) for i, _, key in few)
    for path in (paths[0], paths[-1]):
        sizes = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
        assert len(sizes) >= 9 and max(r["count"] for r in sizes) <= records // 4
