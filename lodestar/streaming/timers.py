"""Streams that act while nothing comes: keep-alives by event-time timers.

A timer fires when the watermark passes it, and the watermark follows the events of all keys, so a silent key is told about
during its silence. The state store must be RocksDB's (``prepared`` sets it for the session).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestar.streaming.state import DAY, LATE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def prepared(spark: SparkSession) -> None:
    """Timers need this state store; streams of the session that begin from now on use it."""
    spark.conf.set(PROVIDER, ROCKSDB)


class KeepAlives(StatefulProcessor):
    """Of each key the time of its last event and how many keep-alives have been sent since."""

    def __init__(self, interval: float, keep: float):
        self.interval, self.keep = interval, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "seconds double, sent long")

    def _rows(self, key: tuple, times: list[float]) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([key[0]] * len(times), dtype=object), "at": pd.to_datetime([round(t * 1e6) for t in times], unit="us")})

    def _wait(self, seconds: float, sent: int) -> None:
        """For the next keep-alive; a key silent for too long is forgotten."""
        if (sent + 1) * self.interval <= self.keep:
            self.handle.registerTimer(math.ceil(1000 * (seconds + (sent + 1) * self.interval)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at if isinstance(at, int) else at[0])
        last, sent = self.state.get() if self.state.exists() else (None, 0)
        out = []
        for now in sorted(x for batch in rows for x in batch["seconds"]):
            if last is not None:  # what the watermark has not told yet
                due = max(0, math.ceil((now - last) / self.interval) - 1)
                out += [last + i * self.interval for i in range(sent + 1, due + 1)]
            if last is None or now > last:
                last, sent = now, 0
        self.state.update((last, sent))
        self._wait(last, sent)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, sent = self.state.get()
        told, watermark = [], timerValues.getCurrentWatermarkInMs() / 1000
        while (sent + 1) * self.interval <= self.keep and last + (sent + 1) * self.interval <= watermark:
            sent += 1
            told.append(last + sent * self.interval)
        if (sent + 1) * self.interval > self.keep:
            self.state.clear()
        else:
            self.state.update((last, sent))
            self._wait(last, sent)
        yield self._rows(key, told)

    def close(self) -> None:
        pass


def keep_alives(stream: DataFrame, interval: float, keep: float = DAY) -> DataFrame:
    """(key, at) of a stream with key and ts: one for each whole ``interval`` without an event of the key, sent when the
    watermark has passed it, so before the key's next event comes; in order by key. After ``keep`` seconds of silence a
    key is forgotten. Rows behind the watermark are dropped; rows of one key in one batch are taken in time order."""
    prepared(stream.sparkSession)
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("seconds")
    rows = stream.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), seconds).withWatermark("ts", LATE)
    return rows.groupBy("key").transformWithStateInPandas(KeepAlives(interval, keep), "key string, at timestamp", "append", "eventtime")
