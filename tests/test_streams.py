"""Streams: keep-alives during a silence, message blocks and request metrics equal to their batch forms."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodestar.plans import live
from lodestar.sources.tables import table
from lodestar.streaming import limits, state, timers

START = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)


def run(out, tmp_path):
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(240)
    assert q.exception() is None
    return out.sparkSession.read.schema(out.schema).parquet(str(tmp_path / "out"))


def in_batches(spark, tmp_path, batches):
    """A stream whose n-th trigger reads the n-th list of (key, seconds)."""
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, START + datetime.timedelta(seconds=s)) for k, s in rows], "key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{i:02}"))
    return spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


@pytest.fixture
def partitions(spark):
    """Few tasks: a state store a task is slow to open."""
    was = spark.conf.get(timers.PROVIDER, None)
    yield
    spark.conf.set(timers.PROVIDER, was) if was else spark.conf.unset(timers.PROVIDER)


def test_keep_alives_come_during_a_silence(spark, tmp_path, partitions):
    """Key a is silent while b goes on: its keep-alives are sent as the watermark passes, though it never comes back; those
    of c, which does come back, are sent once, and a gap within one batch is filled too."""
    stream = in_batches(spark, tmp_path, [[("a", 0), ("b", 0), ("c", 5)], [("b", 1000)], [("b", 2000), ("c", 2000), ("c", 2300)], [("b", 3000)], [("b", 3001)]])
    found = {}
    for r in run(timers.keep_alives(stream, 100.0), tmp_path).select("key", F.unix_seconds("at").alias("s")).collect():
        found.setdefault(r.key, []).append(r.s - int(START.timestamp()))
    watermark = 3001 - 600
    assert sorted(found["a"]) == list(range(100, watermark + 1, 100))
    assert sorted(found["b"]) == [s for a in (0, 1000, 2000) for s in range(a + 100, a + 1000, 100)]
    assert sorted(found["c"]) == [*range(105, 2000, 100), 2100, 2200, 2400]


def test_a_silent_key_is_forgotten(spark, tmp_path, partitions):
    stream = in_batches(spark, tmp_path, [[("a", 0), ("b", 0)], [("b", 5000)], [("b", 9000)], [("b", 9001)]])
    found = run(timers.keep_alives(stream, 100.0, keep=350.0), tmp_path).where("key = 'a'")
    assert sorted(r.s - int(START.timestamp()) for r in found.select(F.unix_seconds("at").alias("s")).collect()) == [100, 200, 300]


def test_message_blocks_as_a_stream(spark, sf_dir, tmp_path):
    calls = live.calls(table(spark, sf_dir, "events"))
    source = tmp_path / "events"
    calls.withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
    of = lambda df: sorted((r.event_id, r.block or 0) for r in df.collect())
    assert of(run(state.follow(stream, state.block_rule()), tmp_path)) == of(state.message_blocks(calls))


def test_request_metrics_as_streams(spark, sf_dir, tmp_path):
    rows = live.requests(table(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    end = rows.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 40 DAYS"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    end.write.parquet(str(tmp_path / "in" / "b"))  # closes all windows before it
    for name, job in (("red", limits.red_metrics), ("counts", limits.request_counts)):
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        found = run(job(stream, 1440), tmp_path / name)
        want = job(rows, 1440)
        assert want.count() > 20 and sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        assert "method" in found.columns and found.where("n = 0").count() == 0
    assert not rows.where("path = '/healthz'").isEmpty()
    assert limits.request_counts(rows).agg(F.sum("n")).first()[0] == rows.where("path <> '/healthz'").count()
