"""Histograms and density aggregates over cells. The binning rules differ on purpose; see each function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismview.functions.shared import quantiles, settled


def bin_open(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Bin of x, right edge excluded; null outside."""
    return F.when((x >= lo) & (x < hi), F.floor((x - lo) * (bins / (hi - lo))).cast("int"))


def bin_closed(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Bin of x, the right edge in the last bin; null outside."""
    return F.when((x >= lo) & (x <= hi), F.least(F.floor((x - lo) * (bins / (hi - lo))), F.lit(bins - 1)).cast("int"))


def hist1d(df: DataFrame, x: Column, lo: float, hi: float, bins: int = 60) -> DataFrame:
    """bin, n, height (square root of the share of the fullest bin) for every bin; right edge excluded."""
    found = df.select(bin_open(x, lo, hi, bins).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    dense = every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    top = found.agg(F.max("n").alias("top")).first()["top"] or 1
    return dense.withColumn("height", F.sqrt(F.col("n") / F.lit(top)))


def hist2d(df: DataFrame, x: Column, y: Column, box: tuple[float, float, float, float], nx: int, ny: int, closed: bool = False, weight: Column | None = None) -> DataFrame:
    """ix, iy, n, w of the cells that hold a row."""
    cut = bin_closed if closed else bin_open
    cells = df.select(cut(x, box[0], box[1], nx).alias("ix"), cut(y, box[2], box[3], ny).alias("iy"), (F.lit(1.0) if weight is None else weight).alias("_w"))
    return cells.where("ix is not null and iy is not null").groupBy("ix", "iy").agg(F.count("*").alias("n"), F.sum("_w").alias("w"))


def view_density(view: DataFrame, box: tuple[float, float, float, float], nx: int, ny: int, color: Column | None = None, selected: Column | None = None) -> DataFrame:
    """ix, iy, weight (sum of vis), colored (sum of vis where the colour is present), color_sum, selected: all integers but color_sum,
    if the colour is one."""
    cells = view.where("vis > 0").withColumns({"ix": bin_open(F.col("X"), box[0], box[1], nx), "iy": bin_open(F.col("Y"), box[2], box[3], ny),
                                               "_c": F.lit(None).cast("double") if color is None else color, "_s": F.lit(False) if selected is None else selected})
    return (cells.where("ix is not null and iy is not null").groupBy("ix", "iy")
            .agg(F.sum("vis").alias("weight"), F.sum(F.when(F.col("_c").isNotNull(), F.col("vis")).otherwise(0)).alias("colored"),
                 F.sum(F.col("vis") * F.col("_c")).alias("color_sum"), F.sum(F.when(F.col("_s"), F.col("vis")).otherwise(0)).alias("selected")))


def class_density(view: DataFrame, box: tuple[float, float, float, float], nx: int, ny: int, code: str, codes: int = 8) -> DataFrame:
    """ix, iy, and the summed vis of each code as w0, w1, ..."""
    cells = view.where("vis > 0").withColumns({"ix": bin_open(F.col("X"), box[0], box[1], nx), "iy": bin_open(F.col("Y"), box[2], box[3], ny)})
    sums = [F.sum(F.when(F.coalesce(F.col(code), F.lit(0)) == k, F.col("vis")).otherwise(0)).alias(f"w{k}") for k in range(codes)]
    return cells.where("ix is not null and iy is not null").groupBy("ix", "iy").agg(*sums)


def tone(weight: Column, reference: float, gain: float = 1.0, floor: float = 0.0) -> Column:
    """Brightness of a cell: max((1 - exp(-gain w / reference)) ** 0.8, floor)."""
    return F.greatest(F.pow(1 - F.exp(-gain * weight / reference), F.lit(0.8)), F.lit(floor))


def view_bounds(view: DataFrame, least: int = 20) -> DataFrame:
    """One row: 0.5 and 99.5 % of X and Y over shown rows; the box -3..3 below ``least`` rows."""
    shown = settled(view.where("vis >= 77").select("X", "Y"), "view-bounds")
    n = shown.count()
    (x0, x1), (y0, y1) = (quantiles(shown, c, [0.005, 0.995]) if n >= least else (-3.0, 3.0) for c in ("X", "Y"))
    return view.sparkSession.createDataFrame([(n, x0, x1, y0, y1)], "n long, x_lo double, x_hi double, y_lo double, y_hi double")


def exposure_reference(view: DataFrame, box: tuple[float, float, float, float], nx: int, ny: int, rows: int, kernel: float = 1.0) -> DataFrame:
    """One row, the density that counts as bright: cells, merged 2 x 2 at most twice while the median occupied cell holds under 10
    rows; the 95th percentile of the level chosen, per unmerged cell and scaled to all rows; null below 40 rows in view.

    All three levels come from one aggregate of the finest cells.
    """
    fine = hist2d(view.where("vis > 0"), F.col("X"), F.col("Y"), box, nx, ny).select("ix", "iy", "n")
    levels = fine.select(F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("ix", k).alias("cx"), F.shiftright("iy", k).alias("cy"), F.col("n")) for k in range(3)])).alias("x")).select("x.*")
    merged = levels.groupBy("level", "cx", "cy").agg(F.sum("n").alias("n")).groupBy("level").agg(F.sum("n").alias("total"), F.median("n").alias("mid"), F.percentile("n", 0.95).alias("p95"))
    wide = merged.agg(F.max("total").alias("total"), *[F.max(F.when(F.col("level") == k, F.col(c))).alias(f"{c}{k}") for k in range(3) for c in ("mid", "p95")])
    level = F.when(F.col("mid0") >= 10, 0).when(F.col("mid1") >= 10, 1).otherwise(2)
    p95 = F.when(F.col("level") == 0, F.col("p950")).when(F.col("level") == 1, F.col("p951") / 4).otherwise(F.col("p952") / 16)
    return wide.withColumn("level", level).select("total", "level", F.when(F.col("total") >= 40, p95 * rows / F.col("total") * kernel * 0.6).alias("reference"))


def prefix_cells(view: DataFrame, rank: str, prefix: int, x: Column, y: Column, box: tuple[float, float, float, float], nx: int, ny: int, least: int = 3) -> DataFrame:
    """Cells of the first ``prefix`` rows of the random order that hold ``least`` rows or more."""
    return hist2d(view.where(F.col(rank) < prefix), x, y, box, nx, ny).where(F.col("n") >= least).select("ix", "iy", "n")


def grid_bounds(df: DataFrame, rank: str, tail: float = 0.001, most: int = 20_000) -> DataFrame:
    """One row: x0, x1, y0, y1, the nearest-rank quantiles of X and Y in every n-th row (about ``most`` rows, or up to twice as many)."""
    step = max(1, df.count() // most)
    few = df.where(F.col(rank) % step == 0).agg(F.array_sort(F.collect_list("X")).alias("xs"), F.array_sort(F.collect_list("Y")).alias("ys"))
    at = lambda a, p: F.get(a, F.floor(p * (F.size(a) - 1) + 0.5).cast("int"))
    return few.select(*[at(F.col(a), p).alias(n) for n, a, p in (("x0", "xs", tail), ("x1", "xs", 1 - tail), ("y0", "ys", tail), ("y1", "ys", 1 - tail))])
