"""Keyed state with a feed of its changes: on a stream with timers, on a table with windows, the same rows.

Each key holds the payload of its highest order number. An event with a higher number than the key's is an insert or an update, any
other one changes nothing. A key without events for ``idle`` is let go (an expire, at its last event plus idle), and its next event is
an insert again, whatever its number.

On a stream the state lives in the state store, one row per key; events are taken in the order of their times within a batch, rows
behind the watermark are dropped, and an expire is fired by an event-time timer once the watermark has passed it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MICRO = 1_000_000


def _few(df: DataFrame, key: str, ts: str, order: str, payload: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(ts).alias("at"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(order).alias("seq"), F.col(payload).alias("payload"))


def change_feed(df: DataFrame, key: str, ts: str, order: str, payload: str, idle_seconds: int, until: str | None = None) -> DataFrame:
    """key, us (microseconds since 1970), change (insert, update, expire), seq, payload (both null for an expire) of a table.

    until: the time up to which a key's last expire is told; the others are told whenever they are due.
    """
    few = _few(df, key, ts, order, payload)
    w = Window.partitionBy("key").orderBy("us", "seq")
    idle = idle_seconds * MICRO
    seen = few.withColumn("gap", F.col("us") - F.lag("us").over(w)).withColumn("life", F.sum(F.when(F.col("gap") > idle, 1).otherwise(0)).over(w))
    own = Window.partitionBy("key", "life").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("seq").over(own)
    changes = seen.withColumn("top", top).where("top is null or seq > top").select("key", "us", F.when(F.col("top").isNull(), "insert").otherwise("update").alias("change"), "seq", "payload")
    ends = seen.groupBy("key", "life").agg((F.max("us") + idle).alias("us"), F.max("life").alias("_l"))
    last = F.max("life").over(Window.partitionBy("key"))
    due = F.lit(False) if until is None else F.col("us") <= F.unix_micros(F.lit(until).cast("timestamp"))
    gone = ends.withColumn("last", last).where((F.col("life") < F.col("last")) | due)
    none = lambda c: F.lit(None).cast(few.schema[c].dataType).alias(c)
    return changes.unionByName(gone.select("key", "us", F.lit("expire").alias("change"), none("seq"), none("payload"))).withColumnRenamed("key", key)


class _Feed(StatefulProcessor):
    def __init__(self, idle_seconds: int, state: T.StructType):
        self.idle, self.schema = idle_seconds * MICRO, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", self.schema)

    def _timer(self, us: int | None) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if us is not None:
            self.handle.registerTimer(-(-(us + self.idle) // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        top, last = (held[0], held[1]) if held else (None, None)
        out = []
        for seq, us, payload in sorted(((r.seq, r.us, r.payload) for f in rows for r in f.itertuples(index=False)), key=lambda r: (r[1], r[0])):
            if last is not None and us - last > self.idle:
                out.append((key[0], last + self.idle, "expire", None, None))
                top = None
            if top is None or seq > top:
                out.append((key[0], us, "insert" if top is None else "update", seq, payload))
                top = seq
            last = us if last is None else max(last, us)
        self.state.update((top, last))
        self._timer(last)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            _, last = self.state.get()
            self.state.clear()
            yield self._frame([(key[0], last + self.idle, "expire", None, None)])

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["key", "us", "change", "seq", "payload"], dtype=object)


def change_stream(df: DataFrame, key: str, ts: str, order: str, payload: str, idle_seconds: int, lateness: str = "10 minutes") -> DataFrame:
    """``change_feed`` of a stream, in append mode. It needs the RocksDB state store (see ``with_state_store``)."""
    few = _few(df.withColumn(ts, F.col(ts).cast("timestamp")), key, ts, order, payload).withWatermark("at", lateness)
    kind = lambda c: few.schema[c].dataType
    state = T.StructType([T.StructField("seq", kind("seq")), T.StructField("us", T.LongType())])
    out = T.StructType([T.StructField("key", kind("key")), T.StructField("us", T.LongType()), T.StructField("change", T.StringType()), T.StructField("seq", kind("seq")), T.StructField("payload", kind("payload"))])
    fed = few.groupBy("key").transformWithStateInPandas(_Feed(idle_seconds, state), out, "Append", "EventTime")
    return fed.withColumnRenamed("key", key)


def with_state_store(spark) -> None:
    """State of streams that start from now on is kept by RocksDB, on local disks, and its changes in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
