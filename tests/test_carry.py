"""State machines over keys that lie in many partitions, against one loop per key."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismview.streaming.carry import Hysteresis, Smoothing, carried

MANY = 1_000_000


def loop(values, ratio):
    base, out = None, []
    for v in values:
        if not math.isnan(v) and (base is None or v > base * ratio or v < base / ratio):
            base = v
            out.append(v)
    return base, out


VALUES = st.lists(st.one_of(st.floats(0.01, 100), st.sampled_from([1.0, 1.35, 2.0, math.nan])), max_size=40)


@settings(max_examples=400, deadline=None)
@given(VALUES, st.one_of(st.none(), st.floats(0.01, 100)), st.sampled_from([1.0, 1.35, 2.0]))
def test_hysteresis_summary_is_the_way_from_any_state(values, base, ratio):
    m, rows = Hysteresis("v", ratio), {"v": np.array(values, dtype=float)}
    assert m.after(base, m.summary(rows)) == m.step(base, rows)[0]


def test_hysteresis_summary_of_a_rising_piece_is_short():
    m = Hysteresis("v", 2.0)
    first, high, low = m.summary({"v": np.random.default_rng(1).lognormal(0, 1, 100_000)})
    assert first is not None and len(high) + len(low) < 60


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 50), st.one_of(st.floats(-5, 5), st.just(math.nan))), max_size=30), st.one_of(st.none(), st.tuples(st.floats(-50, 0), st.floats(-5, 5))))
def test_smoothing_summary(rows, state):
    m = Smoothing("t", "v", 7.0)
    t, v = (np.array([r[i] for r in sorted(rows, key=lambda r: r[0])], dtype=float) for i in (0, 1))
    a, b = m.after(state, m.summary({"t": t, "v": v})), m.step(state, {"t": t, "v": v})[0]
    assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-9))


def test_one_key_of_a_million_rows_lies_in_several_tasks(spark):
    i = F.col("id")
    df = spark.range(MANY).select(F.lit("all").alias("k"), i.alias("n"), (F.lit(50.0) + F.pmod(i * 7919, F.lit(997)) / 20 + 40 * F.sin(i / 9000.0)).alias("v"))
    got = carried(df, "k", ["n"], Hysteresis("v", 1.35))
    assert got.withColumn("p", F.spark_partition_id()).select("p").distinct().count() >= 3
    values = [r["v"] for r in df.orderBy("n").collect()]
    assert [r["v"] for r in got.orderBy("n").collect()] == loop(values, 1.35)[1]


def test_keys_of_all_sizes(spark):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for k, size in (("a", 4000), ("b", 1), ("c", 2), (None, 900), ("d", 0), ("e", 3000)):
        for _ in range(size):
            rows.append((k, n, float(n), None if n % 11 == 0 else float(rng.lognormal()), "kept"))
            n += 1
    df = spark.createDataFrame(rows, "k string, n long, t double, v double, other string").repartition(7)
    kept, smooth = carried(df, "k", ["n"], Hysteresis("v", 2.0)).collect(), carried(df, "k", ["n"], Smoothing("t", "v", 50.0)).collect()
    m = Smoothing("t", "v", 50.0)
    for key in ("a", "b", "c", None, "e"):
        own = [r for r in rows if r[0] == key]
        values = [math.nan if r[3] is None else r[3] for r in own]
        assert [r["v"] for r in sorted((r for r in kept if r["k"] == key), key=lambda r: r["n"])] == loop(values, 2.0)[1]
        want = m.step(None, {"t": np.array([r[2] for r in own]), "v": np.array(values)})[2]["smooth"]
        got = [math.nan if r["smooth"] is None else r["smooth"] for r in sorted((r for r in smooth if r["k"] == key), key=lambda r: r["n"])]
        assert got == pytest.approx(want.tolist(), nan_ok=True)
    assert {r["other"] for r in kept} == {"kept"}
    assert carried(df.limit(0), "k", ["n"], Hysteresis("v", 2.0)).count() == 0
