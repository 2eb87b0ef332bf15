"""Nearest rows and matches against all pairs, where rows cluster, near the poles and across 0 degrees."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismview.operators import nearest as n


def vectors(lon, lat):
    a, d = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], axis=1)


def by_all_pairs(left, right, limit, ok=lambda a, b: True, rounds=1):
    """left, right: id -> position. {left id: (right id, round)}."""
    free, todo, out, k = dict(right), dict(left), {}, 0
    while todo and (rounds is None or k < rounds):
        k += 1
        takes = {}
        ids = np.array(sorted(free))
        at = np.array([free[i] for i in ids.tolist()])
        for a, p in todo.items() if len(ids) else ():
            d2 = ((at - p) ** 2).sum(axis=1)
            j = int(d2.argmin())
            if d2[j] <= limit * limit and ok(a, int(ids[j])):
                takes.setdefault(int(ids[j]), []).append((d2[j], a))
        given = {b: min(x)[1] for b, x in takes.items()}
        out |= {a: (b, k) for b, a in given.items()}
        todo = {a: left[a] for x in takes.values() for _, a in x if a not in out}
        free = {b: p for b, p in free.items() if b not in given}
    return out


@pytest.fixture(scope="module")
def sky():
    """Positions in arc seconds around a pole, around (0, 0), in one very dense spot, and spread."""
    rng = np.random.default_rng(6)

    def some(k):
        lon, lat = rng.uniform(0, 360, k), 90 - np.abs(rng.normal(0, 6, k)) / 3600
        far = rng.uniform(-6, 6, (k, 2)) / 3600
        dense = rng.normal(0, 0.1, (2 * k, 2)) / 3600
        spread = np.stack([rng.uniform(0, 360, k), np.degrees(np.arcsin(rng.uniform(-1, 1, k)))], axis=1)
        return np.concatenate([np.stack([lon, lat], axis=1), np.stack([far[:, 0] % 360, far[:, 1]], axis=1), np.stack([180 + dense[:, 0], -45 + dense[:, 1]], axis=1), spread, -90 + np.zeros((3, 2))])

    return some(120), some(150)


def tables(spark, sky):
    return (spark.createDataFrame([(i, float(a), float(b), i % 10) for i, (a, b) in enumerate(p)], f"{k} long, ra double, dec double, z int") for p, k in zip(sky, "lr", strict=True))


@pytest.mark.parametrize("rounds", [1, None])
def test_sky_match_equals_all_pairs(spark, sky, rounds):
    left, right = tables(spark, sky)
    got = n.sky_match(left, right, "l", "r", 2.0, rounds=rounds, load=16, accept=F.abs(F.col("z") - F.col("r_z")) < 7).collect()
    at = [dict(enumerate(vectors(p[:, 0], p[:, 1]))) for p in sky]
    want = by_all_pairs(*at, 2 * math.sin(math.radians(2 / 3600) / 2), lambda a, b: abs(a % 10 - b % 10) < 7, rounds)
    assert {r["l"]: (r["r"], r["round"]) for r in got} == want and len(got) == len(want)
    assert len({r["r"] for r in got}) == len(got) and max(r["sep"] for r in got) <= 2.0 + 1e-6
    assert max(r["round"] for r in got) > 1 or rounds == 1


def test_used_candidates_are_passed_over(spark, sky):
    left, right = tables(spark, sky)
    got = {r["l"]: r["r"] for r in n.sky_match(left, right, "l", "r", 2.0, used=right.where("r % 2 = 0"), load=8).collect()}
    at = [dict(enumerate(vectors(p[:, 0], p[:, 1]))) for p in sky]
    want = by_all_pairs(at[0], {k: v for k, v in at[1].items() if k % 2}, 2 * math.sin(math.radians(2 / 3600) / 2))
    assert got == {a: b for a, (b, _) in want.items()}


def test_no_leaf_over_its_load(spark, sky):
    _, right = tables(spark, sky)
    from prismview.functions.scalars import unit_vector

    axes = ["x", "y", "z"]
    at = right.select("r", *[u.alias(a) for a, u in zip(axes, unit_vector(F.col("ra"), F.col("dec")), strict=True)]).groupBy(*axes).agg(F.min("r").alias("r")).cache()
    levels, leaves = n.cell_tree(at, axes, 2.0 ** -16, 8)
    loads = leaves.groupBy("_level", "_c0", "_c1", "_c2").agg(F.count("*").alias("n")).collect()
    assert max(r["n"] for r in loads) <= 8 and sum(r["n"] for r in loads) == at.count() and len(levels) > 2


def test_a_query_meets_few_rows_of_a_dense_spot(spark):
    """20,000 rows within the limit of each of 300 queries: the joined rows are a few leaves a query, not six million pairs."""
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 0.05, (20_000, 2)))], "r long, x double, y double")
    points = rng.normal(0.2, 0.1, (300, 2))
    asks = spark.createDataFrame([(float(a), float(b)) for a, b in points], "x double, y double")
    seen = []
    real = n._reached

    def spy(*args):
        out = real(*args)
        seen.append(out)
        return out

    n._reached, before = spy, n._reached
    try:
        got = {(r["x"], r["y"]): r["r"] for r in n.nearest_rows(asks, rows, "r", ["x", "y"], 1.0).collect()}
    finally:
        n._reached = before
    at = np.array([(r["x"], r["y"]) for r in rows.orderBy("r").collect()])
    assert got == {(float(a), float(b)): int(((at - (a, b)) ** 2).sum(axis=1).argmin()) for a, b in points}
    assert len(seen) > 4


def test_ties_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(5, 0.0, 0.0), (2, 0.0, 0.0), (1, 2.0, 0.0), (9, None, 1.0), (8, float("nan"), 1.0)], "r long, x double, y double")
    asks = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (None, 0.0), (40.0, 40.0), (0.0, 0.0)], "x double, y double")
    assert sorted((r["x"], r["r"], r["d2"]) for r in n.nearest_rows(asks, rows, "r", ["x", "y"], 1.0, load=1).collect()) == [(0.0, 2, 0.0), (1.0, 1, 1.0)]
    assert n.nearest_rows(asks, rows.limit(0), "r", ["x", "y"], 1.0).count() == 0 and n.nearest_rows(asks.limit(0), rows, "r", ["x", "y"], 1.0).count() == 0
    left = asks.withColumn("l", F.monotonically_increasing_id())
    assert n.matched(left, rows.limit(0), "l", "r", ["x", "y"], 1.0, rounds=None).count() == 0


def test_equal_distances(spark):
    rows = spark.createDataFrame([(7, 1.0, 0.0), (3, -1.0, 0.0), (5, 0.0, 1.0), (9, 0.0, -1.0)], "r long, x double, y double")
    got = n.nearest_rows(spark.createDataFrame([(0.0, 0.0)], "x double, y double"), rows, "r", ["x", "y"], 1.0).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0, 3, 1.0)]
