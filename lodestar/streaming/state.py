"""Keyed event logic with state: sliding limits, circuit breakers, answer caches, message blocks.

Each rule is a step (state, row) -> (state, output). ``replay`` folds it over a bounded table, ``follow`` over a stream;
both order the rows of a key by (ts, event_id), so that the results agree on data within the watermark. What windows can
say (breakers, blocks) has a batch form in windows only.

Rows need key, ts (timestamp), event_id; null keys are one key. An empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

DAY = 86_400
LATE = "10 minutes"


class Rule:
    """A step function, the columns it reads and adds, and for how long an idle key's state is kept."""

    def __init__(self, step: Callable, reads: list[str], adds: str, keep: float):
        self.step, self.reads, self.adds, self.keep = step, reads, adds, keep


def sliding_limit(most: int, per_day: int, window: float = 60.0) -> Rule:
    """At most ``most`` hits in ``window`` seconds and ``per_day`` in a UTC day; a row's cost is so many hits.

    The day is tested first. Refused hits are not recorded, so a key's state holds at most ``most`` times.
    ``retry_after`` is in seconds, null when accepted.
    """

    def step(state, row):
        now = row.seconds
        recent = [t for t in state.get("hits", []) if now - t <= window]
        today = int(now // DAY)
        used = state["used"] if state.get("day") == today else 0
        cost = int(row.cost)
        wait = None
        if used + cost > per_day:
            wait = DAY - now % DAY
        elif len(recent) + cost > most:
            wait = max(1.0, window - (now - recent[0])) if recent else window
        else:
            recent, used = recent + [now] * cost, used + cost
        return {"hits": recent, "day": today, "used": used}, (wait is None, wait)

    return Rule(step, ["cost"], "accepted boolean, retry_after double", max(window, DAY))


def daily_budget(most: int) -> Rule:
    """At most ``most`` units of cost in a UTC day; a refused row costs nothing. ``used``: units spent after the row."""

    def step(state, row):
        today = int(row.seconds // DAY)
        used = state["used"] if state.get("day") == today else 0
        accepted = used + int(row.cost) <= most
        used += int(row.cost) if accepted else 0
        return {"day": today, "used": used}, (accepted, used)

    return Rule(step, ["cost"], "accepted boolean, used long", DAY)


def silences(interval: float) -> Rule:
    """Keep-alives due since a key's last event: one for each whole ``interval`` without any. ``last``: when the last was due."""

    def step(state, row):
        before = state.get("seconds")
        n = 0 if before is None else max(0, math.ceil((row.seconds - before) / interval) - 1)
        return {"seconds": row.seconds}, (n, before + n * interval if n else None)

    return Rule(step, [], "n long, last double", DAY)


def block_rule() -> Rule:
    """The step form of ``message_blocks``: rows outside any block have a null one."""

    def step(state, row):
        kind, n = state.get("kind"), state.get("n", 0)
        if row.kind in ("text", "reasoning"):
            n += kind != row.kind
            return {"kind": row.kind, "n": n}, (n,)
        return {"kind": None if row.kind == "failure" else kind, "n": n}, (None,)

    return Rule(step, ["kind"], "block long", DAY)


def ttl_cache(ttl: float = 86_400.0) -> Rule:
    """Is a question answered from the cache: same revision, no older than ``ttl`` seconds. A miss stores the answer."""

    def step(state, row):
        hit = state.get("revision") == row.revision and row.seconds - state["created"] <= ttl
        return (state if hit else {"revision": row.revision, "created": row.seconds}), (bool(hit),)

    return Rule(step, ["revision"], "hit boolean", ttl)


def breaker_rule(base: float = 60.0, cap: float = 900.0) -> Rule:
    """The step form of ``breaker``, for streams."""

    def step(state, row):
        allowed = row.seconds >= state.get("until", float("-inf"))
        if not row.failed:
            return {}, (allowed, 0, None)
        n = state.get("failures", 0) + 1
        if row.status == 404:
            pause = 6 * 3600.0
        elif row.daily:
            pause = 3600.0
        elif row.retry_after is not None and row.retry_after == row.retry_after:
            pause = row.retry_after + 1.0
        else:
            pause = min(base * 2.0 ** min(n - 1, 60), cap)
        return {"failures": n, "until": row.seconds + pause}, (allowed, n, row.seconds + pause)

    return Rule(step, ["failed", "status", "daily", "retry_after"], "allowed boolean, failures long, open_until double", 7 * 3600.0)


def _prepared(rows: DataFrame, rule: Rule) -> DataFrame:
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("seconds")
    return rows.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", seconds, *rule.reads)


def _rows(out: list, names: list[str]) -> pd.DataFrame:
    """As objects, so that a missing whole number stays one."""
    return pd.DataFrame(out, columns=names, dtype=object).astype({"event_id": "int64"})


def replay(rows: DataFrame, rule: Rule) -> DataFrame:
    """(event_id, key, <added columns>) of a bounded table.

    Keys are hashed over the tasks and sorted within them, on disk where need be; a task then reads its rows in batches
    and holds one key's state, so that a hot key takes time, not memory.
    """
    schema = f"event_id long, key string, {rule.adds}"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, first = None, {}, True
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if first or row.key != key:
                    key, state, first = row.key, {}, False
                state, added = rule.step(state, row)
                out.append((row.event_id, row.key, *added))
            yield _rows(out, names)

    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return _prepared(rows, rule).repartition("key").sortWithinPartitions("key", "seconds", "event_id").mapInPandas(fold, schema)


def follow(stream: DataFrame, rule: Rule) -> DataFrame:
    """The same as a stream. Rows behind the watermark are dropped; a key idle for ``rule.keep`` seconds is forgotten."""
    schema = f"event_id long, key string, {rule.adds}"
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def update(key: tuple, batches: Iterator[pd.DataFrame], saved: GroupState) -> Iterator[pd.DataFrame]:
        if saved.hasTimedOut:
            saved.remove()
            return
        state = json.loads(saved.get[0]) if saved.exists else {}
        rows = pd.concat(list(batches)).sort_values(["seconds", "event_id"])
        out = []
        for row in rows.itertuples(index=False):
            state, added = rule.step(state, row)
            out.append((row.event_id, row.key, *added))
        saved.update((json.dumps(state),))
        at = int(1000 * (rows.seconds.iloc[-1] + rule.keep))
        saved.setTimeoutTimestamp(max(at, saved.getCurrentWatermarkMs() + 1))
        yield _rows(out, names)

    from pyspark.sql.types import _parse_datatype_string

    kept = StructType([StructField("state", StringType())])
    return _prepared(stream, rule).withWatermark("ts", LATE).groupBy("key").applyInPandasWithState(update, _parse_datatype_string(schema), kept, "append", GroupStateTimeout.EventTimeTimeout)


def breaker(rows: DataFrame, base: float = 60.0, cap: float = 900.0) -> DataFrame:
    """(event_id, key, allowed, failures, open_until): circuit breaker by key, by windows alone.

    A success closes it. The n-th failure in a row opens it for base * 2^(n-1) seconds, at most ``cap``; a 404 for six
    hours, a spent daily quota for one, and a retry-after for that and a second. ``allowed``: was it closed before the row.
    """
    w = Window.partitionBy("key").orderBy("seconds", "event_id")
    failed = F.coalesce(F.col("failed"), F.lit(False))
    runs = _prepared(rows, breaker_rule()).withColumn("failed", failed).withColumn("_run", F.count_if(~failed).over(w))
    n = F.count_if("failed").over(Window.partitionBy("key", "_run").orderBy("seconds", "event_id"))
    pause = F.when(F.col("status") == 404, 6 * 3600.0).when(F.col("daily"), 3600.0).when(F.col("retry_after").isNotNull(), F.col("retry_after") + 1).otherwise(F.least(base * F.pow(F.lit(2.0), F.col("failures") - 1), F.lit(cap)))
    opened = runs.withColumn("failures", n).withColumn("open_until", F.when(F.col("failed"), F.col("seconds") + pause))
    return opened.select("event_id", "key", F.coalesce(F.col("seconds") >= F.lag("open_until").over(w), F.lit(True)).alias("allowed"), "failures", "open_until")


def message_blocks(rows: DataFrame) -> DataFrame:
    """(event_id, key, block): deltas of kind text or reasoning in a row share a block, numbered from 1 within a key.

    The other kind or a failure closes the open block; further kinds leave it open and have a null block.
    """
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    part = F.col("kind").isin("text", "reasoning")
    marks = rows.where(part | (F.col("kind") == "failure"))
    new = F.when(part & ~F.col("kind").eqNullSafe(F.lag("kind").over(w)), 1).otherwise(0)
    numbered = marks.withColumn("_n", new).select("event_id", "key", "kind", F.sum("_n").over(w).alias("block")).where(part).drop("kind")
    others = rows.where(~F.coalesce(part, F.lit(False))).select("event_id", "key", F.lit(None).cast("long").alias("block"))
    return numbered.unionByName(others)
