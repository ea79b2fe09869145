"""State by key: deadlines that outlive any window, and an index of content that resumes.

Both are stateful processors over ``transformWithState``: one small value a key in the state store, partitioned by the
key's hash, so a hot key costs one task's rows of a batch and one value. ``keep_state`` names the state store that they need.
A restart with the same checkpoint goes on with the state it left.
"""

from __future__ import annotations

from typing import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> SparkSession:
    """Queries started from now on keep their state in the store that timers and values need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class _Cooldowns(StatefulProcessor):
    """The latest deadline of a host; a timer at it forgets the host once the watermark has passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "micros long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ends = [r["__until"] for r in rows if r["__until"] is not None]
        held = self.until.get()[0] if self.until.exists() else None
        now = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000
        latest = max(ends, default=now)
        if latest <= now or (held is not None and latest <= held):
            return
        if held is not None:
            self.handle.deleteTimer(_timer(held))
        self.handle.registerTimer(_timer(latest))
        self.until.update((latest,))
        yield Row(key=key[0], micros=latest, state="deferred")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.until.exists():
            (held,) = self.until.get()
            self.until.clear()
            yield Row(key=key[0], micros=held, state="released")

    def close(self) -> None:
        pass


def _timer(micros: int) -> int:
    return -(-micros // 1000)


def host_cooldowns(events: DataFrame, host: str = "host", at: str = "at", seconds: str = "seconds", late: str = "10 minutes") -> DataFrame:
    """(host, retry_at, state) as hosts are deferred to a later time than before and released again.

    Deferrals are (host, at, seconds). A host's deadline is the latest of all it met, in whatever hour; it is ``released`` when the
    watermark, ``late`` behind the newest ``at``, passes it. Deadlines that the watermark has passed already, and rows whose time or
    seconds are null, change nothing; a null host is a host of its own.
    """
    until = F.unix_micros(F.col(at).cast("timestamp")) + F.col(seconds).cast("long") * 1_000_000
    rows = events.select(F.col(host).alias("__host"), F.col(at).cast("timestamp").alias("__at"), until.alias("__until")).where("__at is not null").withWatermark("__at", late)
    schema = T.StructType([T.StructField("key", events.schema[host].dataType), T.StructField("micros", T.LongType()), T.StructField("state", T.StringType())])
    out = rows.groupBy("__host").transformWithState(_Cooldowns(), schema, "Update", "eventTime")
    return out.select(F.col("key").alias(host), F.timestamp_micros("micros").alias("retry_at"), "state")


class _Content(StatefulProcessor):
    """The newest version of a key that was handed on, and its digest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "version long, digest string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = None
        for r in rows:
            this = (-1 if r["__version"] is None else r["__version"], r["__digest"] or "")
            newest = this if newest is None or this > newest else newest
        held = self.done.get() if self.done.exists() else None
        if newest is None or (held is not None and newest[0] < held[0]):
            return
        self.done.update(newest)
        if held is None or held[1] != newest[1]:
            yield Row(key=key[0], version=newest[0], digest=newest[1], state="new" if held is None else "changed")

    def close(self) -> None:
        pass


def content_index(found: DataFrame, key: str, version: str, digest: str) -> DataFrame:
    """(key, version, digest, state): what has to be read again, ``new`` or ``changed``, once each.

    Of a key's rows in a batch the newest version counts (of equal ones the largest digest); versions older than the one handed on and
    contents that are as they were give nothing. Null versions are the oldest (-1), a null digest is the empty one.
    """
    rows = found.select(F.col(key).alias("__key"), F.col(version).cast("long").alias("__version"), F.col(digest).cast("string").alias("__digest"))
    schema = T.StructType([T.StructField("key", found.schema[key].dataType), *T.StructType.fromDDL("version long, digest string, state string").fields])
    out = rows.groupBy("__key").transformWithState(_Content(), schema, "Update", "none")
    return out.select(F.col("key").alias(key), F.col("version").alias(version), F.col("digest").alias(digest), "state")
