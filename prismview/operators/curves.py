"""Reference curves: formulas as columns, sampled grids, interpolation joins, residuals, offsets."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismview.functions.scalars import interpolated
from prismview.functions.shared import quantiles, settled


def polynomial(x: Column, coefficients: list[float]) -> Column:
    """Coefficients from the constant upwards, by Horner's rule."""
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(float(c))
    return out


def asymptotic(x: Column, top: float, turn: float, slope: float) -> Column:
    """top - log10(1 + (10**turn / 10**x) ** slope): flat at large x."""
    return F.lit(top) - F.log10(1 + F.pow(F.lit(10.0), (F.lit(turn) - x) * slope))


def broken_power(x: Column, top: float, turn: float, gamma: float, beta: float) -> Column:
    """top - gamma / beta * log10(1 + 10 ** (beta (turn - x))): a power law that flattens smoothly at turn."""
    return F.lit(top) - gamma / beta * F.log10(1 + F.pow(F.lit(10.0), (F.lit(turn) - x) * beta))


def line(x: Column, slope: float, intercept: float) -> Column:
    return slope * x + intercept


def evolving_line(x: Column, age: float, a: tuple[float, float], b: tuple[float, float]) -> Column:
    """A line whose slope a0 - a1 t and intercept -(b0 - b1 t) follow the age t."""
    return (a[0] - a[1] * age) * x - (b[0] - b[1] * age)


def hyperbola(x: Column, top: float, pole: float, offset: float) -> Column:
    """top / (x - pole) + offset, left of the pole only."""
    return F.when(x < pole, top / F.nullif(x - F.lit(pole), F.lit(0.0)) + offset)


def two_piece(x: Column, turn: float, left: tuple[float, float], right: tuple[float, float]) -> Column:
    return F.when(x < turn, line(x, *left)).otherwise(line(x, *right))


def plane(x: Column, y: Column, a: float, b: float, c: float) -> Column:
    return a * x + b * y + c


def double_power_fraction(x: Column, norm: float, turn: float, beta: float, gamma: float) -> Column:
    """log10 of 2 norm / ((m/m1)^-beta + (m/m1)^gamma) times m, for x = log10 m."""
    d = x - F.lit(turn)
    return x + F.log10(F.lit(2 * norm) / (F.pow(F.lit(10.0), -beta * d) + F.pow(F.lit(10.0), gamma * d)))


def grid(lo: float, hi: float, n: int = 61) -> list[float]:
    return [round(float(v), 4) for v in np.linspace(lo, hi, n)]


def sampled(formula: Callable[[np.ndarray], np.ndarray], lo: float, hi: float, n: int = 61) -> list[tuple[float, float]]:
    xs = np.array(grid(lo, hi, n))
    return [(float(a), round(float(b), 4)) for a, b in zip(xs, formula(xs), strict=True) if math.isfinite(b)]


def by_arclength(points: list[tuple[float, float]], n: int = 61) -> list[tuple[float, float]]:
    """n points at equal distances along a polyline."""
    p = np.array(points)
    s = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
    at = np.linspace(0, s[-1], n)
    return [(round(float(a), 4), round(float(b), 4)) for a, b in zip(np.interp(at, s, p[:, 0]), np.interp(at, s, p[:, 1]), strict=True)]


def root(f: Callable[[np.ndarray], np.ndarray], lo: np.ndarray, hi: np.ndarray, steps: int = 60) -> np.ndarray:
    """Bisection for many brackets at once."""
    lo, hi = np.array(lo, dtype=float), np.array(hi, dtype=float)
    left = np.sign(f(lo))
    for _ in range(steps):
        mid = (lo + hi) / 2
        same = np.sign(f(mid)) == left
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid)
    return (lo + hi) / 2


def segments(spark: SparkSession, points: list[tuple[float, float]]) -> DataFrame:
    """x0, x1, y0, y1 of a curve's pieces, for interpolation by a range join."""
    p = sorted(points)
    return spark.createDataFrame([(a[0], b[0], a[1], b[1]) for a, b in zip(p, p[1:], strict=False) if b[0] > a[0]], "x0 double, x1 double, y0 double, y1 double")


def residuals(df: DataFrame, x: Column, y: Column, points: list[tuple[float, float]]) -> DataFrame:
    """df with residual = y - curve(x), null outside the curve."""
    return df.withColumn("residual", y - interpolated(points, x))


def curve_residual(df: DataFrame, x: Column, y: Column, points: list[tuple[float, float]]) -> DataFrame:
    """One row: n and median residual inside the curve's range."""
    r = settled(residuals(df, x, y, points).where("residual is not null").select(F.col("residual").cast("double").alias("residual")), "curve-residuals")
    (mid,) = quantiles(r, "residual", [0.5])
    return r.agg(F.count("*").alias("n"), F.lit(mid).cast("double").alias("mid"))


def fit_offset(df: DataFrame, x: Column, y: Column, points: list[tuple[float, float]], least: int = 50) -> DataFrame:
    """One row: the median residual, 0 below ``least`` rows."""
    return curve_residual(df, x, y, points).select(F.col("n"), F.when(F.col("n") < least, F.lit(0.0)).otherwise(F.col("mid")).alias("offset"))


def rms_about(binned: DataFrame, x: str, y: str, points: list[tuple[float, float]], offset: float = 0.0) -> DataFrame:
    """One row: root mean square of binned medians about curve plus offset."""
    d = F.col(y) - (interpolated(points, F.col(x)) + F.lit(offset))
    return binned.where(d.isNotNull()).agg(F.sqrt(F.avg(d * d)).alias("rms"), F.count("*").alias("n"))


def mode_by_bin(df: DataFrame, bin_col: Column, value: Column, step: float, taps: int = 31, width: float = 3.0) -> DataFrame:
    """bin, mode: the peak of the value's histogram (steps of ``step``), smoothed by a Gaussian of ``taps`` taps. The kernel meets
    the histogram's bins, not the rows; the lower place wins a tie."""
    h = df.select(bin_col.alias("bin"), F.floor(value / step).cast("long").alias("k")).where("bin is not null and k is not null").groupBy("bin", "k").agg(F.count("*").alias("n"))
    half = taps // 2
    kernel = F.array(*[F.lit(math.exp(-0.5 * (i / width) ** 2)) for i in range(-half, half + 1)])
    spread = h.select("bin", "k", "n", F.posexplode(kernel).alias("i", "w")).select("bin", (F.col("k") + F.col("i") - half).alias("k"), (F.col("n") * F.col("w")).alias("v"))
    smooth = spread.groupBy("bin", "k").agg(F.round(F.sum("v"), 9).alias("v"))
    return smooth.groupBy("bin").agg(F.max_by("k", F.struct(F.col("v"), -F.col("k"))).alias("k")).select("bin", ((F.col("k") + 0.5) * step).alias("mode"))


def conditional_fraction(df: DataFrame, bin_col: Column, condition: Column, group: str | None = None, least: int = 1) -> DataFrame:
    keys = [bin_col.alias("bin")] + ([F.col(group)] if group else [])
    return df.groupBy(*keys).agg(F.count("*").alias("n"), (F.count_if(condition) / F.count("*")).alias("fraction")).where((F.col("n") >= least) & F.col("bin").isNotNull())
