"""Binned statistics along an axis: four binning rules that look alike and differ, kept apart on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismview.functions.quantiles import group_median, group_quantiles
from prismview.functions.shared import IN_A_TASK, quantiles, settled
from prismview.operators.density import bin_closed, bin_open

BAND = (0.16, 0.5, 0.84)


def _bands(df: DataFrame, keys: list[str], y: str, most: int) -> DataFrame:
    """keys, n, lo, mid, hi of each group with a value of y."""
    q = group_quantiles(df, keys, y, list(BAND), most)
    return q.select(*keys, "n", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("lo", "mid", "hi"))])


def running_quantiles(df: DataFrame, x: str, y: str, lo: float, hi: float, bins: int = 24, least: int = 30, group: str | None = None, most: int = IN_A_TASK) -> DataFrame:
    """(group,) bin, n, lo, mid, hi: 16, 50 and 84 % of y; the right edge belongs to the last bin; bins of ``least`` rows or more.
    most: see ``functions.quantiles.quantiles_of``, here and below."""
    keys = ([group] if group else []) + ["bin"]
    cut = df.withColumn("bin", bin_closed(F.col(x), lo, hi, bins)).where("bin is not null")
    return _bands(cut, keys, y, most).where(F.col("n") >= least)


def running_median_open(df: DataFrame, x: str, y: str, lo: float, hi: float, bins: int, least: int = 30, most: int = IN_A_TASK) -> DataFrame:
    """As running_quantiles, but x = hi is left out."""
    cut = df.withColumn("bin", bin_open(F.col(x), lo, hi, bins)).where("bin is not null")
    return _bands(cut, ["bin"], y, most).where(F.col("n") >= least)


def running_median_midx(df: DataFrame, x: str, y: str, edges: list[float], least: int = 40, most: int = IN_A_TASK) -> DataFrame:
    """bin, n, x_mid, y_mid: medians of both coordinates in a <= x < b."""
    k = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: F.col(x) >= e)) - 1
    cut = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("bin", k).where((F.col("bin") >= 0) & (F.col("bin") < len(edges) - 1))
    sides = [F.struct(F.lit(side).alias("side"), F.col(c).cast("double").alias("value")) for side, c in (("x", x), ("y", y))]
    mids = group_median(cut.select("bin", F.explode(F.array(*sides)).alias("s")).select("bin", "s.*"), ["bin", "side"], "value", "mid", most)
    one = lambda side: F.max(F.when(F.col("side") == side, F.col("mid")))
    return mids.groupBy("bin").agg(F.max("n").alias("n"), one("x").alias("x_mid"), one("y").alias("y_mid")).where(F.col("n") >= least)


def equal_groups(df: DataFrame, value: str, groups: int) -> tuple[DataFrame, list[float], list[float]]:
    """df with ``group`` (0..groups-1; a value on an edge goes up; null stays null), the inner edges, the group medians."""
    q = [k / groups for k in range(1, groups)] + [(k + 0.5) / groups for k in range(groups)]
    got = quantiles(settled(df.select(value), "group-values"), value, q)
    edges, mids = list(got[:groups - 1]), list(got[groups - 1:])
    group = sum((F.when(F.col(value) >= F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    return df.withColumn("group", F.when(F.col(value).isNotNull(), group)), edges, mids


def trend(view: DataFrame, x: str, y: str, lo: float, hi: float, bins: int = 24, least: int = 30, group: str | None = None, least_group: int = 200, selected: str | None = None,
          most: int = IN_A_TASK) -> DataFrame:
    """part ('all', a group's value, 'selected'), bin, n, lo, mid, hi. A group needs twice ``least`` rows per bin and ``least_group`` in all,
    the selection twice ``least`` per bin. All bins of all parts are groups of one call."""
    parts = [F.lit("all")]
    if group:
        parts.append(F.when(F.col(group).isNotNull(), F.col(group).cast("string")))
    if selected:
        parts.append(F.when(F.col(selected), F.lit("selected")))
    cut = view.withColumn("bin", bin_closed(F.col(x), lo, hi, bins)).where("bin is not null")
    each = cut.withColumn("part", F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())))
    found = _bands(each, ["part", "bin"], y, most).withColumn("total", F.sum("n").over(Window.partitionBy("part")))
    ok = F.when(F.col("part") == "all", F.col("n") >= least).when(F.col("part") == "selected", F.col("n") >= 2 * least).otherwise((F.col("n") >= 2 * least) & (F.col("total") >= least_group))
    return found.where(ok).drop("total")


def smoothed(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """value by weights 1-2-1 along order; the ends count themselves; a null stays null, and is replaced by the middle for its neighbours."""
    w = Window.partitionBy(*group).orderBy(order)
    v = F.col(value)
    return df.withColumn("smooth", F.when(v.isNotNull(), (F.coalesce(F.lag(value).over(w), v) + 2 * v + F.coalesce(F.lead(value).over(w), v)) / 4))


def runs(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """group, run, value, first, last, n: stretches of equal value along order; a null ends a stretch and forms none."""
    w = Window.partitionBy(*group).orderBy(order)
    marked = df.withColumn("_new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)).withColumn("run", F.sum("_new").over(w))
    return (marked.where(F.col(value).isNotNull()).groupBy(*group, "run").agg(F.first(value).alias("value"), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")))


def filled(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Nulls between values linear in order, nulls at the ends carried flat."""
    back = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy(*group).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(order))
    d = df.withColumns({"_a": F.last(value, True).over(back), "_b": F.first(value, True).over(on), "_pa": F.last(at, True).over(back), "_pb": F.first(at, True).over(on)})
    mix = F.col("_a") + (F.col("_b") - F.col("_a")) * ((F.col(order) - F.col("_pa")) / F.nullif(F.col("_pb") - F.col("_pa"), F.lit(0)))
    return d.withColumn("filled", F.coalesce(F.col(value).cast("double"), mix, "_a", "_b")).drop("_a", "_b", "_pa", "_pb")


def cumulative(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Start offsets and running share of value along order."""
    w = Window.partitionBy(*group).orderBy(order)
    total = F.sum(value).over(Window.partitionBy(*group))
    return df.withColumns({"start": F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "share": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) / total})


def level_crossing(df: DataFrame, order: str, value: str, level: float) -> DataFrame:
    """One row: the first place along order where value crosses level, interpolated."""
    w = Window.orderBy(order)  # of a table of bins, not of rows
    d = df.select(order, value).withColumns({"_n": F.lead(value).over(w), "_o": F.lead(order).over(w)})
    hit = d.where((F.col(value) - level) * (F.col("_n") - level) <= 0).where(F.col(value) != F.col("_n"))
    at = F.col(order) + (F.col("_o") - F.col(order)) * ((level - F.col(value)) / (F.col("_n") - F.col(value)))
    return hit.select(F.col(order).alias("_k"), at.alias("at")).agg(F.min_by("at", "_k").alias("at"))


def running_scatter(df: DataFrame, x: str, y: str, bins: int = 24, least: int = 5) -> DataFrame:
    """One row, n and sigma: 1.4826 times the median deviation of y from the running median of y along x.

    The range of x runs between order statistics (floor and ceiling of the places of 1 and 99 %), not between
    interpolated quantiles. Empty bins are filled from their neighbours, the curve is linear between bin centres.
    """
    d = settled(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y")), "scatter")
    n = d.count()
    if n < 2:
        return d.agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("sigma"))
    import math

    places = [math.floor(0.01 * (n - 1)), math.ceil(0.99 * (n - 1))]
    lo, hi = quantiles(d, "x", [p / (n - 1) for p in places])
    if hi <= lo:
        return d.agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("sigma"))
    w = (hi - lo) / bins
    k = F.least(F.greatest(F.floor((F.col("x") - lo) / w), F.lit(0)), F.lit(bins - 1)).cast("int")
    mids = group_median(d.where(F.col("x").between(lo, hi)).withColumn("bin", k), ["bin"], "y").where(F.col("n") >= least)
    every = d.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), F.lit(0).alias("_g")).join(mids, "bin", "left")
    curve = [r["filled"] for r in filled(every, ["_g"], "bin", "mid").orderBy("bin").collect()]  # a number for each bin
    if any(v is None for v in curve):
        return d.agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("sigma"))
    at = F.least(F.greatest((F.col("x") - lo) / w - 0.5, F.lit(0.0)), F.lit(bins - 1.0))
    values = F.array(*[F.lit(float(v)) for v in curve])
    j = F.least(F.floor(at).cast("int"), F.lit(bins - 2))
    fit = F.get(values, j) + (F.get(values, j + 1) - F.get(values, j)) * (at - j)
    r = settled(d.where(F.col("x").between(lo, hi)).select((F.col("y") - fit).alias("r")), "scatter-residuals", d)
    (mid,) = quantiles(r, "r", [0.5])
    (mad,) = quantiles(r.select(F.abs(F.col("r") - F.lit(mid)).alias("r")), "r", [0.5])
    return r.agg(F.count("*").alias("n"), F.lit(1.4826 * mad).alias("sigma"))


def isotonic(df: DataFrame, x: str, y: str, weight: str | None = None, increasing: bool = True) -> DataFrame:
    """x, y: the knots of the monotonic curve nearest to y (pool adjacent violators, by MLlib)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    d = VectorAssembler(inputCols=[x], outputCol="_x").transform(df.dropna(subset=[x, y]))
    fit = IsotonicRegression(featuresCol="_x", labelCol=y, isotonic=increasing, **({"weightCol": weight} if weight else {})).fit(d)
    return df.sparkSession.createDataFrame([(float(a), float(b)) for a, b in zip(fit.boundaries, fit.predictions, strict=True)], "x double, y double")
