"""Queries over ``events`` with state by user: limits, breakers, caches and blocks, in their batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.tables import table
from lodestar.streaming import limits, state

WINDOW, MOST, PER_DAY, TTL = 5 * 86_400, 3, 2, 20 * 86_400


def calls(events: DataFrame) -> DataFrame:
    """events as calls: purchases cost two, errors fail (some with a status, a daily quota or a retry-after)."""
    failed = F.col("event_type") == "error"
    return events.select(
        F.col("user_id").alias("key"), "ts", "event_id",
        F.when(F.col("event_type") == "purchase", 2).otherwise(1).alias("cost"),
        failed.alias("failed"),
        F.when(failed & (F.col("event_id") % 7 == 0), 404).alias("status"),
        (failed & (F.col("event_id") % 5 == 0)).alias("daily"),
        F.when(failed & (F.col("event_id") % 3 == 0), F.col("event_id") % 100 + 0.5).alias("retry_after"),
        F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (30 * 86_400)).cast("string").alias("revision"),
        F.when(F.col("event_type") == "view", "text").when(F.col("event_type") == "click", "reasoning").when(failed, "failure").otherwise(F.col("event_type")).alias("kind"),
    )


def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    found = state.replay(calls(table(spark, sf, "events")), state.sliding_limit(MOST, PER_DAY, WINDOW))
    return found.select("event_id", "key", "accepted", F.round("retry_after", 3).alias("retry_after"))


def ttl_cache(spark: SparkSession, sf: str) -> DataFrame:
    return state.replay(calls(table(spark, sf, "events")), state.ttl_cache(TTL))


def breaker(spark: SparkSession, sf: str) -> DataFrame:
    found = state.breaker(calls(table(spark, sf, "events")), 100_000.0, 900_000.0)
    return found.withColumn("open_until", F.round("open_until", 3))


def message_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Rows outside any block are given block 0."""
    return state.message_blocks(calls(table(spark, sf, "events"))).fillna(0, ["block"])


def requests(events: DataFrame) -> DataFrame:
    """events as requests: every fifth of the cheapest is a health check, purchases are posted, searches fit no route, errors
    end without a status, and each seventh event is not found."""
    kind, n = F.col("event_type"), F.col("event_id")
    return events.select(
        "ts", F.when((n % 5 == 0) & (F.col("value") < 20), "/healthz").otherwise(F.concat(F.lit("/"), kind, F.lit("/"), F.col("user_id").cast("string"))).alias("path"),
        F.when(kind != "search", F.concat(F.lit("/"), kind, F.lit("/{id}"))).alias("route"), F.when(kind == "purchase", "POST").otherwise("GET").alias("method"),
        F.when(kind != "error", F.when(n % 7 == 0, 404).otherwise(200)).alias("status"), (F.col("value") / 100).alias("latency"), (kind == "error").alias("failed"),
    )


def request_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Requests a day by route, method and status."""
    return limits.request_counts(requests(table(spark, sf, "events")), 1440).withColumn("start", F.unix_seconds(F.col("start").cast("timestamp")))


QUERIES = {f.__name__: f for f in (request_counts, rate_limit, ttl_cache, breaker, message_blocks)}

_SECONDS = "epoch_us(ts) / 1000000.0::DOUBLE"
_STEPS = f"""e AS (SELECT event_id, user_id AS key, {_SECONDS} AS s, CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS cost,
 floor(epoch_us(ts) / 1000000 / 2592000)::BIGINT AS revision, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"""
ORACLES = {
    "request_counts": """SELECT epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS start, CASE WHEN event_type <> 'search' THEN '/' || event_type || '/{id}' ELSE 'unmatched' END AS route, CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method,
 CASE WHEN event_type = 'error' THEN '500' WHEN event_id % 7 = 0 THEN '404' ELSE '200' END AS status, count(*) AS n FROM events WHERE NOT (event_id % 5 = 0 AND value < 20) GROUP BY ALL""",
    "rate_limit": f"""WITH RECURSIVE {_STEPS},
r AS (SELECT key, 0::BIGINT AS i, NULL::BIGINT AS event_id, [0.0::DOUBLE][2:] AS hits, -1::BIGINT AS day, 0 AS used, true AS accepted, NULL::DOUBLE AS retry_after FROM (SELECT DISTINCT key FROM e)
 UNION ALL SELECT key, i, event_id, CASE WHEN busy OR full_ THEN recent ELSE list_concat(recent, list_transform(range(cost), lambda x: s)) END, today, CASE WHEN busy OR full_ THEN before ELSE before + cost END, NOT (busy OR full_),
  CASE WHEN full_ THEN 86400 - (s - today * 86400) WHEN busy THEN CASE WHEN len(recent) > 0 THEN greatest(1.0, {WINDOW} - (s - recent[1])) ELSE {WINDOW} END END
 FROM (SELECT *, before + cost > {PER_DAY} AS full_, len(recent) + cost > {MOST} AS busy FROM (
  SELECT e.key, e.i, e.event_id, e.s, e.cost, floor(e.s / 86400)::BIGINT AS today, list_filter(r.hits, lambda t: e.s - t <= {WINDOW}) AS recent, CASE WHEN r.day = floor(e.s / 86400)::BIGINT THEN r.used ELSE 0 END AS before
  FROM r JOIN e ON e.key IS NOT DISTINCT FROM r.key AND e.i = r.i + 1)))
SELECT event_id, key::VARCHAR AS key, accepted, round(retry_after, 3) AS retry_after FROM r WHERE i > 0""",
    "ttl_cache": f"""WITH RECURSIVE {_STEPS},
r AS (SELECT key, i, event_id, s AS created, revision, false AS hit FROM e WHERE i = 1
 UNION ALL SELECT key, i, event_id, CASE WHEN hit THEN created ELSE s END, CASE WHEN hit THEN old ELSE revision END, hit FROM (
  SELECT e.key, e.i, e.event_id, e.s, e.revision, r.created, r.revision AS old, r.revision = e.revision AND e.s - r.created <= {TTL} AS hit FROM r JOIN e ON e.key IS NOT DISTINCT FROM r.key AND e.i = r.i + 1))
SELECT event_id, key::VARCHAR AS key, hit FROM r""",
    "breaker": f"""WITH e AS (SELECT event_id, user_id AS key, {_SECONDS} AS s, event_type = 'error' AS f FROM events),
g AS (SELECT *, count(*) FILTER (WHERE NOT f) OVER (PARTITION BY key ORDER BY s, event_id) AS run FROM e),
n AS (SELECT *, count(*) FILTER (WHERE f) OVER (PARTITION BY key, run ORDER BY s, event_id) AS failures FROM g),
o AS (SELECT *, CASE WHEN f THEN s + CASE WHEN event_id % 7 = 0 THEN 21600 WHEN event_id % 5 = 0 THEN 3600 WHEN event_id % 3 = 0 THEN event_id % 100 + 1.5 ELSE least(100000.0 * pow(2, failures - 1), 900000.0) END END AS u FROM n)
SELECT event_id, key::VARCHAR AS key, coalesce(s >= lag(u) OVER (PARTITION BY key ORDER BY s, event_id), true) AS allowed, failures, round(u, 3) AS open_until FROM o""",
    "message_blocks": """WITH e AS (SELECT event_id, user_id AS key, ts, CASE event_type WHEN 'view' THEN 'text' WHEN 'click' THEN 'reasoning' WHEN 'error' THEN 'failure' ELSE event_type END AS kind FROM events),
m AS (SELECT *, lag(kind) OVER (PARTITION BY key ORDER BY ts, event_id) AS before FROM e WHERE kind IN ('text', 'reasoning', 'failure')),
b AS (SELECT event_id, sum(CASE WHEN kind <> 'failure' AND kind IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, event_id)::BIGINT AS block, kind FROM m)
SELECT event_id, key, coalesce(block, 0) AS block FROM e LEFT JOIN (SELECT event_id, block FROM b WHERE kind <> 'failure') USING (event_id)""",
}
