"""Event jobs: request metrics, silences and blocks, in their batch form (metrics as a stream too).

Late data: the watermark is ten minutes; the twins take all rows, which is the same on data that is in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds, in seconds, of the latency histogram.
BOUNDS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)


#: Paths that are asked by machines and not counted.
HEALTH = ("/metrics", "/healthz", "/readyz")


def _counted(requests: DataFrame) -> DataFrame:
    """With a watermark where it is a stream; without health checks where a path is given."""
    rows = requests.withWatermark("ts", "10 minutes") if requests.isStreaming else requests
    return rows.where(~F.coalesce(F.col("path").isin(*HEALTH), F.lit(False))) if "path" in rows.columns else rows


def red_metrics(events: DataFrame, minutes: int = 60) -> DataFrame:
    """(start, route, method if given, n, errors, le_<bound>...): cumulative histogram by tumbling window; works on streams
    too. Health checks are left out where events have a path."""
    rows = _counted(events)
    keys = ["route", *(c for c in ("method",) if c in rows.columns)]
    buckets = [F.count_if(F.col("latency") <= b).alias(f"le_{str(b).replace('.', '_')}") for b in BOUNDS]
    return rows.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("errors"), *buckets).select(F.col("w.start").alias("start"), *keys, "n", "errors", *[f"le_{str(b).replace('.', '_')}" for b in BOUNDS])


def request_counts(requests: DataFrame, minutes: int = 60) -> DataFrame:
    """(start, route, method, status, n) of requests(ts, path, route, method, status) by tumbling window: no health checks;
    a path that fits no route is unmatched, a request that ended without a status counts as 500. Works on streams too."""
    rows = _counted(requests).withColumns({"route": F.coalesce("route", F.lit("unmatched")), "status": F.coalesce(F.col("status").cast("string"), F.lit("500"))})
    return rows.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "route", "method", "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "route", "method", "status", "n")


def heartbeats(events: DataFrame, seconds: int) -> DataFrame:
    """(key, at): a keep-alive for each whole interval of silence between an event of a key and its next."""
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    gaps = events.withColumn("ts", F.col("ts").cast("timestamp")).select("key", "ts", F.lead("ts").over(w).alias("nxt")).where("nxt is not null")
    silent = F.floor((F.unix_micros("nxt") - F.unix_micros("ts") - 1) / (seconds * 1_000_000))
    return gaps.withColumn("n", silent).where("n > 0").select("key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"), "ts").select("key", F.timestamp_micros(F.unix_micros("ts") + F.col("i") * seconds * 1_000_000).alias("at"))


def block_ids(events: DataFrame) -> DataFrame:
    """(event_id, key, block): runs of equal kinds of a key, numbered from 1."""
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    new = F.when(F.col("kind").eqNullSafe(F.lag("kind").over(w)), 0).otherwise(1)
    return events.withColumn("_n", new).select("event_id", "key", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("block"))
