"""Relations between columns: correlation, explained variance, robust fits. Sums come from one aggregate, small systems are
solved on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismview.functions.quantiles import group_median
from prismview.functions.shared import IN_A_TASK, forget, quantiles, settled


def pearson(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """a, b, n, r for each pair over the rows where both are present; null below 3 rows, 0 where one doesn't vary."""
    out = []
    for a, b in pairs:
        ok = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(ok, F.col(a).cast("double")), F.when(ok, F.col(b).cast("double"))
        n = F.count(x)
        r = F.when(n < 3, None).when((F.stddev_pop(x) < 1e-12) | (F.stddev_pop(y) < 1e-12), F.lit(0.0)).otherwise(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
        out.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), n.alias("n"), r.alias("r")))
    return df.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def gram(df: DataFrame, terms: list[Column], y: Column) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """(X'X, X'y, y'y, sum of y, n) over complete rows, in one pass."""
    k = len(terms)
    names = [f"t{i}" for i in range(k)]
    d = df.select(*[t.cast("double").alias(n) for t, n in zip(terms, names, strict=True)], y.cast("double").alias("y")).dropna()
    aggs = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]] + [F.sum(F.col(a) * F.col("y")).alias(f"{a}_y") for a in names]
    r = d.agg(*aggs, F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum("y").alias("sy"), F.count("*").alias("n")).first()
    m, v = np.zeros((k, k)), np.array([r[f"{a}_y"] or 0.0 for a in names])
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = r[f"{names[i]}_{names[j]}"] or 0.0
    return m, v, r["yy"] or 0.0, r["sy"] or 0.0, r["n"]


def r_squared(df: DataFrame, xs: list[str], y: str) -> float:
    """Share of y's variance that a linear fit on xs explains; 1 for a singular system, within 0..1."""
    m, v, yy, sy, n = gram(df, [F.lit(1.0), *[F.col(x) for x in xs]], F.col(y))
    if n == 0 or np.linalg.matrix_rank(m, tol=1e-9 * max(1.0, float(np.abs(m).max()))) < len(m):
        return 1.0
    total = yy - sy * sy / n
    return float(np.clip(1 - (yy - np.linalg.solve(m, v) @ v) / total, 0, 1)) if total > 0 else 1.0


def robust_fit(df: DataFrame, terms: list[Column], y: Column, clip: float = 5.0, rounds: int = 4) -> tuple[np.ndarray, float]:
    """(coefficients, robust sigma) of least squares with rows beyond clip sigmas left out, four rounds; the terms are written
    once, and each round reads them for the sums and writes its residuals for the quantiles."""
    names = [f"t{i}" for i in range(len(terms))]
    held = settled(df.select(*[t.cast("double").alias(n) for t, n in zip(terms, names, strict=True)], y.cast("double").alias("y")), "robust-terms")
    cols, d, sigma, beta, before = [F.col(n) for n in names], held, float("nan"), np.zeros(len(terms)), None
    for _ in range(rounds):
        m, v, *_ = gram(d, cols, F.col("y"))
        beta = np.linalg.lstsq(m, v, rcond=None)[0]
        fit = sum((F.lit(float(b)) * c for b, c in zip(beta, cols, strict=True)), F.lit(0.0))
        r = settled(held.withColumn("_r", F.col("y") - fit), "robust-residuals")
        forget(*filter(None, [before]))
        (mid,) = quantiles(r, "_r", [0.5])
        sigma = 1.4826 * (quantiles(r.select(F.abs(F.col("_r") - F.lit(mid)).alias("_r")), "_r", [0.5])[0] or 0.0)
        d, before = r.where(F.abs("_r") < clip * sigma) if sigma > 0 else held, r
    forget(*filter(None, [before]), held)
    return beta, sigma


def imputed(df: DataFrame, target: str, terms: list[Column], beta: np.ndarray) -> DataFrame:
    """Missing values of target replaced by the fit."""
    return df.withColumn(target, F.coalesce(F.col(target), sum((F.lit(float(b)) * t for b, t in zip(beta, terms, strict=True)), F.lit(0.0))))


def binned_slope(binned: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope and intercept of a line through binned medians."""
    return binned.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def group_medians(df: DataFrame, keys: list[str], value: str, least: int = 1, most: int = IN_A_TASK) -> DataFrame:
    """keys, n (values present), mid of groups of ``least`` values or more (one at least), of any size."""
    return group_median(df, keys, value, "mid", most).where(F.col("n") >= least)


def rates(df: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    """Shares of the rows of each group for which conditions hold (a null counts as not)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[(F.count_if(c) / F.count("*")).alias(k) for k, c in conditions.items()])


#: The ranges that color and redshift are clipped to, the redshift the basis is centred on, and for each power of the redshift how
#: many powers of the color go with it.
COLOR_CLIP, REDSHIFT_CLIP, REDSHIFT_MIDDLE, COLOR_POWERS = (-0.5, 2.5), (0.0, 0.3), 0.1, (4, 4, 3)


def color_basis(color: Column, redshift: Column) -> list[Column]:
    """Eleven products of powers of a clipped color and a clipped, centred redshift, for fits and imputation; null where either is missing."""
    c = F.greatest(F.least(color, F.lit(COLOR_CLIP[1])), F.lit(COLOR_CLIP[0]))
    t = F.greatest(F.least(redshift, F.lit(REDSHIFT_CLIP[1])), F.lit(REDSHIFT_CLIP[0])) - REDSHIFT_MIDDLE
    known = color.isNotNull() & redshift.isNotNull() & ~F.isnan(color.cast("double")) & ~F.isnan(redshift.cast("double"))
    return [F.when(known, F.pow(t, F.lit(float(j))) * F.pow(c, F.lit(float(i)))) for j, n in enumerate(COLOR_POWERS) for i in range(n)]
