import os
import shutil

import pytest
from pyspark.sql import functions as F

from clausemill.streaming import stateful


def test_state_machines():
    r = stateful.AllowanceWindow(2, 10.0)
    assert [r.offer(t)[0] for t in (0, 1, 2, 9, 10, 11, 12)] == [True, True, False, False, True, True, False]
    assert r.offer(12)[1] == pytest.approx(8)
    b = stateful.FailureGate(2, 5.0)
    got = [b.offer(t, f) for t, f in ((0, True), (1, False), (2, True), (3, False), (8, False), (9, True))]
    assert got == [("closed", True), ("closed", True), ("open", True), ("open", False), ("closed", True), ("closed", True)]


def streamed(spark, sf, tmp_path, build, mode="append"):
    """Rows of a streaming query over the events, fed in two files in order of time."""
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    half = events.count() // 2
    parts = [events.filter(F.col("event_id") < half), events.filter(F.col("event_id") >= half)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(source)
    stream = build(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source))
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        (f,) = [x for x in os.listdir(tmp_path / f"p{i}") if x.endswith(".parquet")]
        shutil.copy(tmp_path / f"p{i}" / f, f"{source}/{i}.parquet")
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
    return events, spark.read.parquet(out)


def test_rate_limit_stream_equals_batch(spark, sf, tmp_path):
    events, got = streamed(spark, sf, tmp_path, lambda s: stateful.rate_limit_stream(s, 2, 86400.0))
    want = stateful.rate_limit_batch(events, 2, 86400.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.filter("NOT allowed").count() > 0


def test_breaker_stream_equals_batch(spark, sf, tmp_path):
    events, got = streamed(spark, sf, tmp_path, lambda s: stateful.circuit_breaker_stream(s, 2, 86400.0))
    want = stateful.circuit_breaker_batch(events, 2, 86400.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_usage_stream(spark, sf, tmp_path):
    events, got = streamed(spark, sf, tmp_path, lambda s: stateful.usage_stream(s).select(F.col("window.start").alias("start"), "event_type", "n"))
    want = {(r.start, r.event_type): r.n for r in events.groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = {(r.start, r.event_type): r.n for r in got.collect()}
    assert len(rows) > 50 and all(want[k] == n for k, n in rows.items())


def files_of(spark, sf, tmp_path, build, cuts):
    """Feed the events in files cut at the given ids, one a batch, then a last event far later;
    gives the events, the rows, and the state rows after each batch."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
        far = events.limit(1).withColumns({"event_id": F.lit(10**9), "user_id": F.lit(10**6), "ts": F.lit("2030-01-01 00:00:00").cast("timestamp")}).select(events.columns)
        source, out = str(tmp_path / "in"), str(tmp_path / "out")
        os.makedirs(source)
        stream = build(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source))
        sizes = []
        edges = [-1, *cuts, 10**8]
        for i, (a, b) in enumerate([*zip(edges, edges[1:]), (None, None), (None, None)]):
            part = events.filter((F.col("event_id") > a) & (F.col("event_id") <= b)) if a is not None else far.withColumn("event_id", F.lit(10**9 + i).cast("long")).select(events.columns)
            part.coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
            (f,) = [x for x in os.listdir(tmp_path / f"p{i}") if x.endswith(".parquet")]
            shutil.copy(tmp_path / f"p{i}" / f, f"{source}/{i}.parquet")
            q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
            q.awaitTermination(180)
            assert q.exception() is None
            sizes.append(max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress[-1:]))
        return events, spark.read.parquet(out).filter("event_id < 1000000000"), sizes
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_cache_entry():
    c = stateful.CacheEntry(10.0)
    assert [c.offer(t) for t in (0, 3, 9.5, 10, 12, 30)] == [(False, 0, 0.0), (True, 1, 3), (True, 2, 9.5), (False, 0, 0.0), (True, 1, 2), (False, 0, 0.0)]


def test_cache_stream_equals_batch_and_forgets(spark, sf, tmp_path):
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    events, got, sizes = files_of(spark, sf, tmp_path, lambda s: stateful.cache_stream(s, 6 * 3600.0), [n // 3, 2 * n // 3])
    want = stateful.cache_batch(events, 6 * 3600.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.filter("hit").count() > 0 and sizes[-1] < sizes[0]


def test_limiter_state_times_out(spark, sf, tmp_path):
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    events, got, sizes = files_of(spark, sf, tmp_path, lambda s: stateful.rate_limit_stream(s, 2, 86400.0), [n // 2])
    want = stateful.rate_limit_batch(events, 2, 86400.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sizes[-1] < sizes[0]
