import numpy as np
import pytest
from pyspark.sql import functions as F

from prismview.operators import cluster


def inertia(points, centers):
    return ((points[:, None, :] - centers[None]) ** 2).sum(axis=2).min(axis=1).sum()


def full(points, k):
    """Lloyd's rounds to the end, the best of several starts."""
    best = None
    for seed in range(6):
        at = points[np.random.default_rng(seed).choice(len(points), k, replace=False)]
        for _ in range(60):
            near = ((points[:, None, :] - at[None]) ** 2).sum(axis=2).argmin(axis=1)
            at = np.array([points[near == c].mean(axis=0) if (near == c).any() else at[c] for c in range(k)])
        best = min(best or np.inf, inertia(points, at))
    return best


@pytest.mark.parametrize("batch", [400, 1 << 18])
def test_close_to_full_rounds(spark, batch):
    rng = np.random.default_rng(3)
    points = rng.uniform(0, 1, (2400, 2))
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, v array<double>")
    got = cluster.minibatch_kmeans(df, "v", 60, "id", batch=batch, passes=12).orderBy("cluster").collect()
    at = np.array([r["center"] for r in got])
    assert len(got) == 60 and sum(r["members"] for r in got) == 2400
    assert inertia(points, at) <= 1.03 * full(points, 60)


def test_sums_of_a_batch(spark):
    rng = np.random.default_rng(7)
    points, at = rng.normal(0, 1, (500, 3)), rng.normal(0, 1, (9, 3))
    at[8] = 50.0  # meets nothing
    df = spark.createDataFrame([([float(x) for x in p],) for p in points], "_v array<double>").repartition(3)
    n, sums, spare, total = cluster._batch_sums(df, at)
    d = ((points[:, None, :] - at[None]) ** 2).sum(axis=2)
    near = d.argmin(axis=1)
    assert n.tolist() == np.bincount(near, minlength=9).tolist() and n[8] == 0
    assert np.allclose(sums, [points[near == c].sum(axis=0) for c in range(9)]) and total == pytest.approx(d.min(axis=1).sum())
    far = np.sort(d.min(axis=1))[::-1]
    assert np.allclose(sorted((x for x, _ in spare), reverse=True)[:cluster.SPARE], far[:cluster.SPARE]) and len(spare) == 3 * cluster.SPARE


def test_starved_centres_move(spark):
    # the first rows of the order lie almost all in one crowd, the other groups are small and far off
    rng = np.random.default_rng(4)
    places = np.array([(x * 100.0, y * 100.0) for x in range(4) for y in range(4)])
    points = np.concatenate([rng.normal(0, 0.01, (3000, 2)), *[p + rng.normal(0, 0.01, (20, 2)) for p in places[1:]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id long, a double, b double")
    at = np.array([r["center"] for r in cluster.minibatch_kmeans(df, ["a", "b"], 24, "id", batch=1000, passes=8).collect()])
    assert all(((at - p) ** 2).sum(axis=1).min() < 1.0 for p in places)


def test_moves_only_where_it_pays():
    at = np.array([[0.0], [0.1], [50.0], [90.0]])
    weight = np.array([100.0, 5.0, 40.0, 3.0])
    cluster._reseeded(at, weight, weight.copy(), [(400.0, (70.0,)), (396.01, (70.1,)), (1.0, (51.0,))])
    assert at.ravel().tolist() == [0.0, 70.0, 50.0, 90.0] and weight.tolist() == [100.0, 0.0, 40.0, 3.0]
    one = np.array([[1.0]])
    cluster._reseeded(one, np.array([4.0]), np.array([4.0]), [(9.0, (4.0,))])
    assert one.tolist() == [[1.0]]


def test_edge_cases(spark):
    rows = [(1, 1.0, 2.0), (2, 1.0, 2.0), (3, None, 1.0), (4, float("nan"), 1.0), (5, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = sorted((tuple(r["center"]), r["members"]) for r in cluster.minibatch_kmeans(df, ["a", "b"], 7, "id").collect())
    assert got == [((1.0, 2.0), 2), ((5.0, 6.0), 1)]
    assert cluster.minibatch_kmeans(df.where("id > 9"), ["a", "b"], 3, "id").count() == 0
    with pytest.raises(ValueError):
        cluster.minibatch_kmeans(df, ["a", "b"], 0, "id")


def test_thousands_of_centres(spark, small):
    t = spark.read.parquet(f"{small}/lineitem.parquet").selectExpr("l_orderkey * 8 + l_linenumber AS id", "array(l_quantity, l_extendedprice / 1000, l_discount * 100) AS v")
    got = cluster.minibatch_kmeans(t, "v", 4000, "id", batch=2000, passes=2).collect()
    assert len(got) == 4000 and sum(r["members"] for r in got) == t.count()


def test_all_tasks_share_a_batch(spark, monkeypatch):
    # a range of the order lay in one file, so one task had a batch of a large table for itself
    monkeypatch.setattr(cluster, "PIECE", 100, raising=False)
    sums, met = cluster._batch_sums, []

    def counted(rows, at):
        met.append([r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()])
        return sums(rows, at)

    monkeypatch.setattr(cluster, "_batch_sums", counted)
    df = spark.range(3200).select("id", (F.col("id") % 70).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    got = cluster.minibatch_kmeans(df, ["a", "b"], 5, "id", batch=400, passes=2).collect()
    assert sum(r["members"] for r in got) == 3200
    assert len(met) == 16 and sum(map(sum, met)) == 6400 and all(250 < sum(n) < 550 for n in met)
    assert all(len(n) >= 3 and max(n) < 250 for n in met)


def test_ranges_of_the_order(spark):
    rows = spark.createDataFrame([(x, [0.0]) for x in (-(1 << 63), -1, 0, (1 << 63) - 1, *np.random.default_rng(2).integers(-(1 << 63), (1 << 63) - 1, 500).tolist())], "_at long, _v array<double>")
    for turns in (1, 3, 206):
        got, path = cluster._by_turns(rows, turns, 4)
        assert sorted((r["_at"], r["_turn"]) for r in got.collect()) == sorted((r["_at"], (r["_at"] + (1 << 63)) * turns >> 64) for r in rows.collect())
        cluster.discard(path)


def test_few_different_rows(spark):
    # the centres aren't all in the first range
    df = spark.range(4000).select("id", F.when(F.col("id") < 3990, 0.0).otherwise(F.col("id").cast("double")).alias("a"))
    got = cluster.minibatch_kmeans(df, ["a"], 11, "id", batch=200, passes=1).collect()
    assert len(got) == 11 and sum(r["members"] for r in got) == 4000


def test_exactly_nearest():
    rng = np.random.default_rng(5)
    at = np.round(rng.uniform(0, 9, (300, 3)))  # many are equal, and many rows equally far from several
    v = np.concatenate([np.round(rng.uniform(0, 9, (2000, 3)) * 2) / 2 + 1e8, np.round(rng.uniform(0, 9, (2000, 3)) * 2) / 2, [[np.nan, 1, 1]]])
    d = ((v[:, None, :] - at[None]) ** 2).sum(axis=2)
    which, dist = cluster._exactly_nearest(v, at)
    assert (which == d.argmin(axis=1)).all() and np.array_equal(dist, d.min(axis=1), equal_nan=True)
