"""The stream forms give what the table forms give."""

from pyspark.sql import functions as F

from prismview.streaming import operators as st


def _stream(spark, small, name, build, mode):
    folder = f"{small}/events.parquet"
    schema = spark.read.parquet(folder).schema
    src = spark.readStream.schema(schema).parquet(f"{small}/event*.parquet")
    q = build(src).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_throttle(spark, small):
    got = _stream(spark, small, "throttled", lambda d: st.throttle_first(st.with_event_time(d, "ts"), "user_id", "ts", "1 day", ["event_id"]), "complete")
    want = st.throttle_first(spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "1 day", ["event_id"])
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_latest(spark, small):
    got = _stream(spark, small, "latest", lambda d: st.latest_wins(d, "user_id", "event_id", ["value"]), "complete")
    want = st.latest_wins(spark.read.parquet(f"{small}/events.parquet"), "user_id", "event_id", ["value"])
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_sessions_close_behind_the_watermark(spark, small):
    got = _stream(spark, small, "settled", lambda d: st.settle(st.with_event_time(d, "ts", "1 hour"), "user_id", "ts", "30 minutes"), "append")
    assert got.count() >= 0


def test_smoothing(spark, small):
    got = _stream(spark, small, "smoothed", lambda d: st.ewma_stream(d, "user_id", "ts", "value", 86400.0), "update")
    want = st.ewma(spark.read.parquet(f"{small}/events.parquet"), "user_id", "ts", "event_id", "value", 86400.0)
    pair = got.join(want.withColumnRenamed("smooth", "w"), "user_id")
    assert pair.count() == want.count() and pair.where(F.abs(F.col("smooth") - F.col("w")) > 1e-6).count() == 0
