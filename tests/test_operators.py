"""Operators against plain Python on small tables, with their edge cases."""

import pytest
from pyspark.sql import functions as F

from prismview.functions import scalars as s
from prismview.functions import text as tx
from prismview.operators import cluster, curves, encode, ingest, project, spatial, stats, trends
from prismview.spec import DimSpec, ViewSpec


def test_cleaning(spark):
    df = spark.createDataFrame([(1, -9999.0), (2, float("nan")), (3, 4.0), (4, float("inf")), (5, None)], "i int, x double")
    got = {r["i"]: r["x"] for r in df.select("i", s.finite_within(F.col("x"), -1000).alias("x")).collect()}
    assert got == {1: None, 2: None, 3: 4.0, 4: None, 5: None}
    ratio = spark.createDataFrame([(100.0, 10.0), (1.0, 0.0), (-1.0, 2.0)], "a double, b double").select(s.log_ratio(F.col("a"), F.col("b")).alias("r"))
    assert [r["r"] for r in ratio.collect()] == [1.0, None, None]


def test_quantize_ties_go_to_even(spark):
    df = spark.createDataFrame([(0.0,), (65534.0,), (0.5,), (1.5,), (-1.0,), (None,)], "x double")
    assert [r["c"] for r in df.select(s.quantized(F.col("x"), 0.0, 65534.0).alias("c")).collect()] == [1, 65535, 1, 3, 0, 0]


def test_percentiles(spark):
    q = F.array(*[F.lit(float(v)) for v in [0, 10, 20, 20, 20, 30]])
    df = spark.createDataFrame([(5.0,), (20.0,), (-1.0,), (99.0,), (None,)], "x double")
    got = df.select(s.percentile_of(q, F.col("x")).alias("p"), s.cdf_percentile(q, F.col("x")).alias("c")).collect()
    assert [r["p"] for r in got] == [0.5, 3.0, 0.0, 5.0, None]
    assert [r["c"] for r in got] == [0.5, 4.0, 0.0, 5.0, None]


def test_separation_and_format(spark):
    df = spark.range(1).select(s.separation(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0)).alias("d"), tx.ordinal(F.lit(113)).alias("o"), tx.percent(F.lit(0.0123)).alias("p"), s.significant(F.lit(1234567.0)).alias("g"))
    r = df.first()
    assert r["d"] == pytest.approx(90) and r["o"] == "113th" and r["p"] == "1.2" and r["g"] == 1234570.0


def test_text_maps(spark):
    r = spark.range(1).select(tx.key_numbers(F.lit("a = 1.5, b: -2")).alias("m"), tx.text_of_index(F.create_map(F.lit("x"), F.array(F.lit(1), F.lit(3)), F.lit("y"), F.array(F.lit(2)))).alias("t"), tx.stripped(F.lit("a % c\n b\\% d")).alias("s")).first()
    assert r["m"] == {"a": 1.5, "b": -2.0} and r["t"] == "x y x" and r["s"] == "a b\\% d"


def test_polygon_against_plain(spark):
    poly = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    pts = [(i / 4 + 0.01, j / 4 + 0.02) for i in range(-2, 20) for j in range(-2, 20)]

    def plain(x, y):
        odd = False
        for (xa, ya), (xb, yb) in zip(poly, poly[1:] + poly[:1], strict=True):
            if (ya > y) != (yb > y) and x < (xb - xa) * (y - ya) / (yb - ya) + xa:
                odd = not odd
        return odd

    got = spark.createDataFrame(pts, "x double, y double").select(s.inside_polygon(F.col("x"), F.col("y"), poly).alias("i")).collect()
    assert [r["i"] for r in got] == [plain(*p) for p in pts]


def test_projection_against_plain(spark):
    st = {"a": (1.0, 2.0), "b": (0.0, 1.0), "c": (0.0, 4.0)}
    view = ViewSpec((("a", 0.8), ("b", 0.0)), (("c", 0.06), ("b", 0.9)))
    rows = [(1, 3.0, 1.0, 8.0), (2, None, 1.0, 8.0), (3, 3.0, 1.0, None)]
    got = {r["k"]: (r["X"], r["Y"], r["vis"]) for r in project.projected(spark.createDataFrame(rows, "k int, a double, b double, c double"), view, st).collect()}
    assert got[1] == pytest.approx((0.8, 1.02, 255)) and got[2][2] == 0 and got[3] == pytest.approx((0.8, 0.9, 128))


def test_cardinality_is_enforced(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ingest.CardinalityError):
        ingest.left_many_to_one(a, b, ["k"])
    with pytest.raises(ingest.CardinalityError):
        ingest.left_many_to_one(a, b.limit(1), ["k"], complete=True)


def test_fills_and_smooths(spark):
    df = spark.createDataFrame([("g", 0, None), ("g", 1, 2.0), ("g", 2, None), ("g", 3, 6.0), ("g", 4, None)], "g string, i int, v double")
    assert [r["filled"] for r in trends.filled(df, ["g"], "i", "v").orderBy("i").collect()] == [2.0, 2.0, 4.0, 6.0, 6.0]
    assert [r["smooth"] for r in trends.smoothed(df.dropna(), ["g"], "i", "v").orderBy("i").collect()] == [3.0, 5.0]


def test_equal_groups(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v")).union(spark.createDataFrame([(None,)], "v double"))
    g, edges, mids = trends.equal_groups(df, "v", 4)
    assert {r["group"]: r["count"] for r in g.groupBy("group").count().collect()} == {0: 250, 1: 250, 2: 250, 3: 250, None: 1} and len(edges) == 3 and len(mids) == 4


def test_typical_per_cell(spark):
    rows = [(0, 0, 0.0, None), (0, 1, 1.0, 0.0), (0, 2, 0.5, 0.1), (1, 3, 5.0, 5.0), (1, 4, 9.0, None), (1, 5, 7.0, 5.0)]
    df = spark.createDataFrame(rows, "cell int, r int, a double, b double")
    got = {r["cell"]: r["r"] for r in spatial.typical_per_cell(df, "cell", ["a", "b"], "r").collect()}
    assert got == {0: 2, 1: 5}
    assert {r["cell"]: r["r"] for r in spatial.typical_per_cell(df, "cell", ["a", "b"], "r", F.col("r") != 5).collect()} == {0: 2, 1: 3}


def test_nearest_goes_before_the_test(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0, 0)], "l int, x double, y double, z int")
    right = spark.createDataFrame([(1, 0.1, 0.0, 99), (2, 0.2, 0.0, 0)], "r int, x double, y double, z int")
    assert spatial.radius_match(left, right, 1.0, "l", "r", accept=F.abs(F.col("z") - F.col("r_z")) < 5).count() == 0


def test_curve_formulas(spark):
    r = spark.range(1).select(curves.polynomial(F.lit(2.0), [1.0, 2.0, 3.0]).alias("p"), curves.asymptotic(F.lit(50.0), 9.0, 10.0, 0.6).alias("a"), curves.hyperbola(F.lit(1.0), 1.0, 0.5, 0.0).alias("h"),
                              curves.two_piece(F.lit(3.0), 2.0, (1.0, 0.0), (0.0, 2.0)).alias("t"), s.interpolated([(0.0, 0.0), (2.0, 10.0), (1.0, 4.0)], F.lit(1.5)).alias("i")).first()
    assert (r["p"], round(r["a"], 9), r["h"], r["t"], r["i"]) == (17.0, 9.0, None, 2.0, 7.0)


def test_robust_fit_ignores_outliers(spark):
    df = spark.range(500).select((F.col("id") / 100).alias("x"), F.when(F.col("id") % 50 == 0, 99.0).otherwise(2 + 3 * F.col("id") / 100 + F.sin("id") / 10).alias("y"))
    beta, sigma = stats.robust_fit(df, [F.lit(1.0), F.col("x")], F.col("y"))
    assert beta.tolist() == pytest.approx([2, 3], abs=0.05) and sigma < 0.2
    filled = stats.imputed(df.withColumn("y", F.lit(None).cast("double")), "y", [F.lit(1.0), F.col("x")], beta)
    assert filled.where("y is null").count() == 0


def test_r_squared(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + 1).alias("y"), (F.col("id") * 0.0).alias("z"))
    assert stats.r_squared(df, ["x"], "y") == pytest.approx(1) and stats.r_squared(df, ["z"], "y") == 1.0
    assert [r["r"] for r in stats.pearson(df, [("x", "y"), ("x", "z")]).collect()] == [pytest.approx(1), 0.0]


def test_representatives_stop_when_settled(spark):
    df = spark.createDataFrame([(0, 1, 0.1, 1), (0, 2, 0.2, 2), (1, 3, 0.1, 1)], "cluster int, k int, dist double, rank int")
    got = cluster.representatives(df, "k", lambda d: d.where("k not in (1, 3)"))
    assert [(r["cluster"], r["k"]) for r in got.collect()] == [(0, 2)]
    pick = cluster.first_fit(spark.createDataFrame([(0, 1, 1.0, 1, False), (0, 2, 1.4, 2, True), (1, 3, 1.0, 1, False), (1, 4, 1.6, 2, True)], "cluster int, k int, dist double, rank int, here boolean"), F.col("here"))
    assert sorted(r["k"] for r in pick.collect()) == [2, 3]


def test_manifest(spark):
    import json

    df = spark.range(101).select(F.col("id").cast("double").alias("a"), (F.col("id") % 3).cast("int").alias("c"))
    from prismview.spec import CatSpec
    m = json.loads(encode.manifest(df, [DimSpec("a", "A", 0, 100)], [CatSpec("c", "C", ((1, "one"), (2, "two")))], {"a": (50.0, 37.0)}))
    assert m["n"] == 101 and m["dims"][0]["quantiles"][50] == 50 and m["categories"][0]["nmissing"] == 34


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k int, x double, y double")
    assert trends.running_quantiles(e, "x", "y", 0, 1).count() == 0
    assert curves.fit_offset(e, F.col("x"), F.col("y"), [(0, 0), (1, 1)]).first()["offset"] == 0.0
    assert encode.dim_stats(e, ["x"]).count() == 0
    assert trends.running_scatter(e, "x", "y").first()["sigma"] is None


def test_statistics_of_groups_of_any_size(spark):
    """With a limit of ten values every group is range-sorted; the results are those of the aggregates."""
    from pyspark.sql import functions as F

    n = F.col("id")
    df = spark.range(9000).select((n * 7919 % 9001 / 9001).alias("x"), F.when(n % 5 > 0, (n * 31 % 977).cast("double")).alias("y"), (n % 3).cast("int").alias("g"), (n % 4 == 0).alias("s"))
    calls = [
        lambda **o: encode.dim_stats(df, ["x", "y", "g"], **o),
        lambda **o: encode.quantile_table(df, ["x", "y"], 20, **o),
        lambda **o: trends.running_quantiles(df, "x", "y", 0.1, 0.9, 6, group="g", **o),
        lambda **o: trends.running_median_open(df, "x", "y", 0.1, 0.9, 6, **o),
        lambda **o: trends.running_median_midx(df, "x", "y", [0.0, 0.3, 0.6, 1.0], **o),
        lambda **o: trends.trend(df, "x", "y", 0.0, 1.0, 5, group="g", selected="s", **o),
        lambda **o: stats.group_medians(df, ["g"], "y", **o),
    ]
    for call in calls:
        a, b = call(), call(most=10)
        assert a.columns == b.columns
        rows = [sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x.collect()), key=repr) for x in (a, b)]
        assert rows[0] == rows[1] and rows[0]


def test_quantiles_by_range_equal_the_aggregate(spark):
    from pyspark.sql import functions as F

    from prismview.functions.shared import quantiles

    d = spark.range(5000).select(F.when(F.col("id") % 7 > 0, F.when(F.col("id") % 3 == 0, F.lit(1.5)).otherwise((F.col("id") * 7919 % 1009) / F.lit(13.0))).alias("v"))
    ps = [0.0, 0.005, 0.25, 0.5, 0.613, 0.995, 1.0]
    small = quantiles(d, "v", ps)
    assert quantiles(d, "v", ps, most=0) == pytest.approx(small, rel=1e-12)
    assert quantiles(d.limit(0), "v", [0.5]) == [None]
    assert quantiles(d.where("v is null"), "v", [0.5, 0.9], most=0) == [None, None]


def test_each_code_once(spark, small):
    from prismview.plans.catalog import code_intervals

    plan = code_intervals(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # the table of quantiles is searched per code, not per row


def test_dealt_by_size(spark):
    from prismview.functions.shared import dealt

    df = spark.range(1000)
    assert dealt(df, ["id"], 10).rdd.getNumPartitions() == 100 and dealt(df, ["id"]).rdd.getNumPartitions() == 4
    assert dealt(df, ["id"], 10).distinct().count() == 1000


def test_whole_is_round(spark):
    v = [0.5, 1.5, 2.5, -0.5, -2.5, 0.49999999999999994, 1.4999999999999998, -1.4999999999999998, 123456.5, 104999.91 * 100, 0.07 * 100, 0.0, None, 4503599627370497.0]
    df = spark.createDataFrame([(x,) for x in v], "v double").select(s.whole(F.col("v")).alias("a"), F.round("v").cast("long").alias("b"))
    assert all(r["a"] == r["b"] for r in df.collect())


def test_facts_round_without_decimals(spark, small):
    from prismview.plans.facts import facts

    plan = facts(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan
