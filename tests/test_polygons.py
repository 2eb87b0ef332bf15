import random

import pytest
from pyspark.sql import functions as F

from prismview.functions.scalars import inside_polygon
from prismview.operators import polygons as pg

def inside(points, vertices, **options):
    return pg.in_polygons(points, F.col("x"), F.col("y"), vertices, **options)


def polygon(rng, k):
    x, y = rng.uniform(0, 10), rng.uniform(0, 10)
    return [(x + rng.choice([-1, 1]) * rng.randint(0, 16) / 8, y + rng.choice([-1, 1]) * rng.randint(0, 16) / 8) for _ in range(k)]


@pytest.mark.parametrize("options", [{}, {"bands": 1}, {"bands": 7, "sent": 0}, {"sent": 0, "load": 3}])
def test_equals_each_polygon_in_turn(spark, options):
    rng = random.Random(5)
    shapes = [polygon(rng, rng.randint(3, 9)) for _ in range(40)]
    # corners, level sides and points on both, beside random ones; a third of all rows in one place
    rows = [(rng.uniform(-1, 11), rng.uniform(-1, 11)) for _ in range(300)] + [v for s in shapes for v in s] + [(5.0, 5.0)] * 200
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(rows)], "id long, x double, y double").cache()
    vertices = spark.createDataFrame([(k, i, *v) for k, s in enumerate(shapes) for i, v in enumerate(s)], "polygon int, i int, x double, y double")
    got = {(r["id"], r["polygon"]) for r in inside(points, vertices, **options).collect()}
    each = points.select("id", F.explode(F.array(*[F.when(inside_polygon(F.col("x"), F.col("y"), s), F.lit(k)) for k, s in enumerate(shapes)])).alias("k")).where("k is not null")
    assert got == {(r["id"], r["k"]) for r in each.collect()} and len(got) > 100


def test_edge_cases(spark):
    square = [(0, 0, 0.0, 0.0), (0, 1, 1.0, 0.0), (0, 2, 1.0, 1.0), (0, 3, 0.0, 1.0)]
    others = [(None, 0, 0.0, 0.0), (None, 1, 2.0, 0.0), (None, 2, 0.0, 2.0), (None, 3, None, 9.0), (2, 0, 0.0, 0.0), (2, 1, 1.0, 1.0), (3, 0, 5.0, 5.0)]
    vertices = spark.createDataFrame(square + others, "polygon int, i int, x double, y double")
    rows = [(0.5, 0.25, "a"), (0.5, 0.25, "a"), (1.5, 0.25, "b"), (None, 0.5, "c"), (float("nan"), 0.5, "d"), (0.5, float("inf"), "e"), (9.0, 9.0, "f")]
    points = spark.createDataFrame(rows, "x double, y double, band string")
    got = sorted((r["band"], r["polygon"] is None) for r in inside(points, vertices).collect())
    assert got == [("a", False)] * 2 + [("a", True)] * 2 + [("b", True)]
    assert inside(points, vertices.where("polygon > 5")).count() == 0 and inside(points.limit(0), vertices).count() == 0
    assert inside(points, vertices.where("polygon > 5")).columns == ["x", "y", "band", "polygon"]


@pytest.mark.parametrize("options", [{}, {"bands": 1}, {"bands": 7, "load": 3}, {"bands": 64}])
def test_counts_equal_the_pairs(spark, options):
    rng = random.Random(6)
    shapes = [polygon(rng, rng.randint(3, 9)) for _ in range(40)]
    shapes += [shapes[0], [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)], [(1.0, 1.0), (1.0, 1.0)]]  # a repeated one, a large one, one without an inside
    rows = [(rng.uniform(-1, 11), rng.uniform(-1, 11)) for _ in range(1500)] + [v for s in shapes for v in s] + [(rng.randint(0, 80) / 8, rng.randint(0, 80) / 8) for _ in range(1500)] + [(5.0, 5.0)] * 200 + [(float("nan"), 1.0), (None, 1.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(rows)], "id long, x double, y double").cache()
    vertices = spark.createDataFrame([(k or None, i, *v) for k, s in enumerate(shapes) for i, v in enumerate(s)], "polygon int, i int, x double, y double")
    got = pg.counted_in_polygons(points, F.col("x"), F.col("y"), vertices, {"ids": F.col("id")}, **options)
    want = inside(points, vertices).groupBy("polygon").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() > 30
    none = pg.counted_in_polygons(points, F.col("x"), F.col("y"), vertices.where("polygon > 99"), {"ids": F.col("id")})
    assert none.count() == 0 and none.columns == ["polygon", "n", "ids"]


def test_counts_form_no_pairs(spark):
    """400 copies of one polygon around 20,000 points: as pairs 8 million rows; here the outline's cells, once."""
    points = spark.range(20000).select((F.col("id") % 200 / 10.0).alias("x"), (F.floor(F.col("id") / 200) / 5.0).alias("y"))
    corner = [(-1.0, -1.0), (21.0, -1.0), (21.0, 21.0), (-1.0, 21.0)]
    vertices = spark.createDataFrame([(k, i, *v) for k in range(400) for i, v in enumerate(corner)], "polygon int, i int, x double, y double")
    shapes, of = pg._shapes(vertices)
    assert shapes.select("polygon").distinct().count() == 1 and of.count() == 400
    got = pg.counted_in_polygons(points, F.col("x"), F.col("y"), vertices).collect()
    assert len(got) == 400 and {r["n"] for r in got} == {20000}
