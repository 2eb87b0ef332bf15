"""Event logic in forms that run on a stream as on a table: settle, throttle, debounce, latest value, smoothing, hysteresis."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismview.streaming.carry import Hysteresis, Smoothing, carried


def with_event_time(df: DataFrame, ts: str, lateness: str = "10 minutes") -> DataFrame:
    """ts as a timestamp with a watermark; parquet times without a zone are taken as UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def settle(df: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """key, start, settled_at, n: an event train that ends when nothing came for gap (it fires at the last event plus gap)."""
    return df.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("settled_at"), "n")


def throttle_first(df: DataFrame, key: str, ts: str, every: str, payload: list[str]) -> DataFrame:
    """key, start, and the first event's payload in each window."""
    first = F.min(F.struct(ts, *payload)).alias("f")
    return df.groupBy(F.window(ts, every).alias("w"), key).agg(first, F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), *[f"f.{p}" for p in payload], "n")


def debounce(df: DataFrame, key: str, ts: str, gap: str, payload: list[str]) -> DataFrame:
    """key, settled_at, and the last event's payload of each train."""
    last = F.max(F.struct(ts, *payload)).alias("f")
    return df.groupBy(F.session_window(ts, gap).alias("w"), key).agg(last).select(key, F.col("w.end").alias("settled_at"), *[f"f.{p}" for p in payload])


def latest_wins(df: DataFrame, key: str, order: str, payload: list[str]) -> DataFrame:
    """key and the payload of the highest order number; as a stream in update or complete mode."""
    return df.groupBy(key).agg(F.max(F.struct(order, *payload)).alias("f")).select(key, F.col(f"f.{order}").alias(order), *[f"f.{p}" for p in payload])


def ewma(df: DataFrame, key: str, ts: str, tie: str, value: str, tau_seconds: float) -> DataFrame:
    """key, last time, value smoothed with time constant tau over all events of a key, in order.

    The decay to the last event makes it a sum, so keys of any size are combined before the shuffle:
    s = v_0 e^-(T-t_0)/tau + sum of v_i (1 - e^-dt_i/tau) e^-(T-t_i)/tau.
    """
    w = Window.partitionBy(key).orderBy(ts, tie)
    sec = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    d = df.select(key, tie, F.col(value).alias("_v"), F.col(ts), sec.alias("_s")).withColumns({"_p": F.lag("_s").over(w), "_t": F.max("_s").over(Window.partitionBy(key))})
    gain = F.when(F.col("_p").isNull(), F.lit(1.0)).otherwise(1 - F.exp(-(F.col("_s") - F.col("_p")) / tau_seconds))
    return d.groupBy(key).agg(F.max(ts).alias("last_ts"), F.sum(F.col("_v") * gain * F.exp((F.col("_s") - F.col("_t")) / tau_seconds)).alias("smooth"))


def ewma_stream(df: DataFrame, key: str, ts: str, value: str, tau_seconds: float) -> DataFrame:
    """The same on a stream, with the state (time, value) of each key kept between batches."""
    kind = df.schema[key].dataType.simpleString()

    def step(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, s = state.get if state.exists else (None, 0.0)
        for f in frames:
            for t, v in f.sort_values("_s")[["_s", "_v"]].itertuples(index=False):
                s = v if at is None else s + (v - s) * (1 - math.exp(-max(0.0, t - at) / tau_seconds))
                at = t
        state.update((at, s))
        yield pd.DataFrame({key: [k[0]], "at": [at], "smooth": [s]})

    few = df.select(key, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_s"), F.col(value).alias("_v"))
    return few.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, at double, smooth double", "at double, s double", "update", "NoTimeout")


def ewma_trace(df: DataFrame, key: str, ts: str, tie: str, value: str, tau_seconds: float) -> DataFrame:
    """key, tie, smooth: the smoothed value at every event; a key may have any number of them (see ``carry``)."""
    few = df.select(key, tie, F.col(value).cast("double").alias("_v"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_s"))
    return carried(few, key, ["_s", tie], Smoothing("_s", "_v", tau_seconds)).select(key, tie, "smooth")


def hysteresis(df: DataFrame, key: str, ts: str, tie: str, value: str, ratio: float = 1.35) -> DataFrame:
    """Events at which a value has moved by more than ratio from the value at the last such event; the first one counts, nulls never do.
    A key may have any number of events (see ``carry``)."""
    few = df.select(key, tie, F.col(value).cast("double").alias(value), F.unix_micros(F.col(ts).cast("timestamp")).alias("_s"))
    return carried(few, key, ["_s", tie], Hysteresis(value, ratio)).select(key, tie, value)
