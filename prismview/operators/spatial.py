"""Nearest rows and rows by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismview.operators.nearest import matched, nearest_rows


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def pick_nearest(points: DataFrame, rows: DataFrame, radius: float, point_id: str, row_id: str, px: str = "px", py: str = "py", x: str = "X", y: str = "Y") -> DataFrame:
    """point_id, row_id, d2 of the nearest row within radius of each point; the smaller row_id wins a tie."""
    axes = ["_x0", "_x1"]
    asked = points.select(point_id, F.col(px).cast("double").alias("_x0"), F.col(py).cast("double").alias("_x1"))
    return asked.join(nearest_rows(asked, rows.select(row_id, F.col(x).alias("_x0"), F.col(y).alias("_x1")), row_id, axes, radius), axes).select(point_id, row_id, "d2")


def radius_match(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, used: DataFrame | None = None, accept: Column | None = None) -> DataFrame:
    """left_id, right_id, d2: the nearest unused row of right for each left row in the plane (x, y), then the test ``accept`` on that
    pair, then each right row to its nearest left row; see ``nearest.matched``."""
    return matched(left, right, left_id, right_id, ["x", "y"], radius, used, accept).drop("round")


def closest_partner(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, distance: Column) -> DataFrame:
    """Inner join on key, then for each left row the partner at the smallest distance."""
    met = left.join(right, key).withColumn("_d", distance)
    return met.withColumn("_n", F.row_number().over(Window.partitionBy(left_id).orderBy("_d", right_id))).where("_n = 1").drop("_n", "_d")


def typical_per_cell(df: DataFrame, cell_col: str, dims: list[str], row_id: str, eligible: Column | None = None) -> DataFrame:
    """cell, row_id, dist: the row nearest to its cell's mean vector, by mean squared distance over the dimensions present; the
    smaller row_id wins a tie. Means are over all rows of the cell, candidates are the eligible ones."""
    means = df.groupBy(cell_col).agg(*[F.avg(d).alias(f"_m_{d}") for d in dims])
    both = df.join(means, cell_col)
    both = both if eligible is None else both.where(eligible)
    dist, n = F.lit(0.0), F.lit(0)
    for d in dims:
        diff = F.col(d) - F.col(f"_m_{d}")
        dist, n = dist + F.coalesce(diff * diff, F.lit(0.0)), n + F.when(diff.isNotNull(), 1).otherwise(0)
    scored = both.withColumn("_n", n).where("_n > 0").withColumn("dist", dist / F.col("_n"))
    return scored.groupBy(cell_col).agg(F.min(F.struct("dist", row_id)).alias("m")).select(cell_col, f"m.{row_id}", "m.dist")


def nearest_to_center(df: DataFrame, x: Column, y: Column, size: float, row_id: str) -> DataFrame:
    """cx, cy, row_id: in each square cell the row nearest to its centre."""
    d = df.select(row_id, x.alias("_x"), y.alias("_y")).withColumns({"cx": cell(F.col("_x"), size), "cy": cell(F.col("_y"), size)})
    dx, dy = F.col("_x") - (F.col("cx") + 0.5) * size, F.col("_y") - (F.col("cy") + 0.5) * size
    return d.groupBy("cx", "cy").agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), F.col(row_id))).alias("m")).select("cx", "cy", f"m.{row_id}")


def typical_gallery(df: DataFrame, selected: Column, dims: list[str], row_id: str, k: int = 48, least_dims: int = 4) -> DataFrame:
    """row_id, dist: the k selected rows nearest to the selection's mean, with least_dims dimensions or more."""
    s = df.where(selected)
    m = s.agg(*[F.avg(d).alias(d) for d in dims]).first()
    dist, n = F.lit(0.0), F.lit(0)
    for d in dims:
        if m[d] is not None:
            diff = F.col(d) - F.lit(m[d])
            dist, n = dist + F.coalesce(diff * diff, F.lit(0.0)), n + F.when(diff.isNotNull(), 1).otherwise(0)
    return s.withColumn("_n", n).where(F.col("_n") >= least_dims).select(row_id, (dist / F.col("_n")).alias("dist")).orderBy("dist", row_id).limit(k)


def _ranks(t: Column, v: Column) -> tuple[Column, Column]:
    """How many entries of t are below v, and how many are v or below."""
    return F.size(F.filter(t, lambda a: a < v)), F.size(F.filter(t, lambda a: a <= v))


def selection_profile(df: DataFrame, selected: Column, tables: dict[str, list[float]], bins: int = 40) -> DataFrame:
    """dim, bin, mass: the selection's histogram in percentile space; a value tied over a run of quantiles spreads its mass evenly
    over the run."""
    width, each = 100.0 / bins, []
    for d, q in tables.items():
        t = F.array(*[F.lit(float(v)) for v in q])
        v = F.col(d)
        below, upto = _ranks(t, v)
        inner = below - 1 + (v - F.get(t, below - 1)) / F.nullif(F.get(t, below) - F.get(t, below - 1), F.lit(0.0))
        point = F.when(below == 0, F.lit(0.0)).when(below == len(q), F.lit(float(len(q) - 1))).otherwise(inner)
        tied = upto > below
        p0, p1 = F.when(tied, below.cast("double")).otherwise(point), F.when(tied, (upto - 1).cast("double")).otherwise(point)
        b0, b1 = (F.least(F.floor(p / width), F.lit(bins - 1)).cast("int") for p in (p0, p1))
        each.append(F.when(v.isNotNull(), F.struct(F.lit(d).alias("dim"), b0.alias("b0"), b1.alias("b1"))))
    long = df.where(selected).select(F.explode(F.array(*each)).alias("x")).where("x is not null").select("x.*")  # one pass for all dimensions
    rows = long.groupBy("dim", "b0", "b1").agg(F.count("*").alias("n"))
    spread = rows.select("dim", F.explode(F.sequence("b0", "b1")).alias("bin"), (F.col("n") / (F.col("b1") - F.col("b0") + 1)).alias("mass"))
    return spread.groupBy("dim", "bin").agg(F.sum("mass").alias("mass"))
