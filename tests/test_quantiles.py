"""Quantiles of groups by the range sort against the aggregate."""

import random

import pytest
from pyspark.sql import functions as F

from prismview.functions.quantiles import group_median, group_quantiles, quantiles_of, value_counts

PS = [0.0, 0.005, 0.16, 0.5, 0.84, 0.99, 1.0]


def rows_of(df):
    return sorted(((r["a"], r["b"], r["n"], [round(x, 9) for x in r["q"]]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def held(spark):
    rng = random.Random(4)
    rows = []
    for a, b, n in (("x", 1, 4000), ("x", 2, 1), ("y", None, 2500), (None, None, 700), ("z", 3, 0), ("w", 4, 2)):
        rows += [(a, b, rng.choice([7.5, rng.gauss(0, 1), rng.gauss(0, 1)])) for _ in range(n)] + [(a, b, None)]
    rows += [("hot", 5, 1.0)] * 6000 + [("hot", 5, float(k)) for k in range(40)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "a string, b int, v double").withColumn("part", F.col("b"))


def test_equals_the_aggregate_at_any_limit(held):
    present = held.where("v is not null")
    want = sorted(((r["a"], r["b"], r["n"], [round(x, 9) for x in r["q"]]) for r in present.groupBy("a", "b").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, PS))).alias("q")).collect()), key=repr)
    assert len(want) == 6
    for most in (0, 30, 1000, 1 << 20):
        assert rows_of(group_quantiles(held, ["a", "b"], "v", PS, most)) == want


def test_keys_of_any_name(held):
    for names in (["part"], ["n_", "upto"], ["_v", "q_"]):
        d = held.select(*[F.col("b").alias(k) for k in names], "v")
        one, two = (sorted((str(r[names[0]]), r["n"], r["q"]) for r in group_quantiles(d, names, "v", [0.5], most).collect()) for most in (10, 1 << 20))
        assert one == two


def test_whole_table_and_weights(spark, held):
    twice = held.withColumn("w", F.lit(2))
    one, two = group_quantiles(held.union(held), [], "v", [0.25], 5), quantiles_of(value_counts(twice, [], "v", "w"), [0.25], 5)
    assert one.first()["q"] == two.first()["q"] and one.first()["n"] == two.first()["n"] and one.columns == ["n", "q"]
    assert group_quantiles(held.where("v is null"), ["a"], "v", PS, 0).count() == 0


def test_no_partition_of_the_sort_holds_a_large_group(spark, monkeypatch):
    """A single group of 40,000 values lies in several ranges of the sort."""
    from prismview.functions import quantiles as m

    seen = []
    real = m.settled

    def spy(df, name, *done, **options):
        out = real(df, name, *done, **options)
        if name == "sorted-values":
            seen.append([r["n"] for r in out.groupBy("_range").agg(F.count("*").alias("n")).collect()])
        return out

    monkeypatch.setattr(m, "settled", spy)
    df = spark.range(40_000).select(F.lit(1).alias("a"), F.rand(3).alias("v"))
    got = group_median(df, ["a"], "v", most=100).first()
    assert got["n"] == 40_000 and abs(got["mid"] - df.agg(F.median("v")).first()[0]) < 1e-12
    assert len(seen[0]) >= 4 and max(seen[0]) < 20_000
