"""The change feed of a stream is that of the table; rows behind the watermark are dropped, idle keys expire."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from prismview.streaming import feed


@pytest.fixture()
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    feed.with_state_store(spark)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def replayed(spark, tmp_path, batches, idle):
    """Change rows of a stream whose files arrive one after the other."""
    src, n = tmp_path / "src", 0
    src.mkdir()
    schema = batches[0].schema
    for b in batches:
        n += 1
        b.coalesce(1).write.parquet(str(tmp_path / f"b{n}"))
        for f in (tmp_path / f"b{n}").glob("part-*"):
            f.rename(src / f"{n:03}.parquet")
        q = feed.change_stream(spark.readStream.schema(schema).parquet(str(src)), "k", "ts", "n", "v", idle)
        q = q.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def rows_of(df):
    return sorted(((r["k"], r["us"], r["change"], r["seq"], r["payload"]) for r in df.collect()), key=repr)


def test_replay_of_events_equals_the_table(spark, small, store, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select(F.col("user_id").alias("k"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") * 7919 % 1009).alias("n"), F.col("value").alias("v"))
    cuts = [r for r in events.agg(F.percentile(F.unix_micros("ts"), F.array(F.lit(0.4), F.lit(0.8)))).first()[0]]
    us = F.unix_micros("ts")
    parts = [events.where(us < cuts[0]), events.where((us >= cuts[0]) & (us < cuts[1])), events.where(us >= cuts[1])]
    idle = 2 * 86400
    got = replayed(spark, tmp_path, parts, idle)
    end = events.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    want = feed.change_feed(events, "k", "ts", "n", "v", idle, until=str(end))
    a, b = rows_of(got), rows_of(want)
    assert a == b and {r[2] for r in a} == {"insert", "update", "expire"}


def test_late_rows_are_dropped_and_idle_keys_expire(spark, store, tmp_path):
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    frame = lambda rows: spark.createDataFrame(rows, "k string, ts timestamp, n long, v double")
    first = frame([("a", at(0), 1, 1.0), ("b", at(60), 1, 2.0)])
    late = frame([("a", at(1), 9, 9.0), ("b", at(61), 2, 3.0)])  # a's row is 59 minutes behind the newest one
    last = frame([("a", at(200), 1, 4.0)])
    got = replayed(spark, tmp_path, [first, late, last], 1800)
    minutes = lambda r: (r["us"] - int(at(0).replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)) // 60_000_000
    assert sorted((r["k"], minutes(r), r["change"], r["payload"]) for r in got.collect()) == [
        ("a", 0, "insert", 1.0), ("a", 30, "expire", None), ("a", 200, "insert", 4.0), ("b", 60, "insert", 2.0), ("b", 61, "update", 3.0), ("b", 91, "expire", None)]
