"""Statistics of dimensions, quantized encoding, row order, budgeted sampling, the manifest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismview.functions.quantiles import COUNT, VALUE, group_quantiles, largest_group, quantiles_of, value_counts
from prismview.functions.scalars import decoded, quantized
from prismview.functions.shared import IN_A_TASK, ranked
from prismview.spec import CatSpec, DimSpec

MAD = 1.4826


def long_form(df: DataFrame, dims: list[str]) -> DataFrame:
    """dim, value for every present value: a dimension's statistics are then groups, not columns."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("double").alias("value")) for d in dims])).alias("x")).select("x.*").where("value is not null and not isnan(value)")


def dim_stats(df: DataFrame, dims: list[str], most: int = IN_A_TASK) -> DataFrame:
    """dim, n, lo, hi, center (median), scale (1.4826 times the median deviation; the population deviation if that is 0).

    df is read once; all else works on the different values of each dimension with their numbers. most: see ``quantiles_of``."""
    counts = value_counts(long_form(df, dims), ["dim"], "value")
    largest = largest_group(counts)
    center = quantiles_of(counts, [0.5], most, largest).select("dim", F.get("q", F.lit(0)).alias("center"))
    off = F.col(VALUE) - F.col("center")
    d = counts.join(F.broadcast(center), "dim").withColumns({"off": off, "far": F.abs(off)})  # a row for each dimension
    far = d.select("dim", F.col("far").alias(VALUE), COUNT) if largest <= most else value_counts(d, ["dim"], "far", COUNT)
    mad = quantiles_of(far, [0.5], most, largest).select("dim", F.get("q", F.lit(0)).alias("mad"))
    mean = F.sum(F.col("off") * F.col(COUNT)) / F.sum(COUNT)
    sd = F.sqrt(F.greatest(F.sum(F.col("off") * F.col("off") * F.col(COUNT)) / F.sum(COUNT) - mean * mean, F.lit(0.0)))
    rest = d.groupBy("dim").agg(F.sum(COUNT).alias("n"), F.min(VALUE).alias("lo"), F.max(VALUE).alias("hi"), F.first("center").alias("center"), sd.alias("sd"))
    return rest.join(F.broadcast(mad), "dim").select("dim", "n", "lo", "hi", "center", F.when(F.col("mad") > 1e-12, MAD * F.col("mad")).otherwise(F.col("sd")).alias("scale"))


def quantile_table(df: DataFrame, dims: list[str], parts: int = 100, most: int = IN_A_TASK) -> DataFrame:
    """dim, k, q: the exact quantiles at k / parts. most: see ``quantiles_of``."""
    q = group_quantiles(long_form(df, dims), ["dim"], "value", [k / parts for k in range(parts + 1)], most)
    return q.select("dim", F.posexplode("q").alias("k", "q"))


def round_trip(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """dim, n_present, n_coded, n_missing_differs, max_error in half steps of the code."""
    out = []
    for k, (lo, hi) in ranges.items():
        code = quantized(F.col(k), lo, hi)
        back = decoded(code, lo, hi)
        step = (hi - lo) / 65534
        out.append(F.struct(F.lit(k).alias("dim"), F.count_if(F.col(k).between(lo, hi)).alias("n_present"), F.count_if(code > 0).alias("n_coded"),
                            F.count_if((code > 0) != F.coalesce(F.col(k).between(lo, hi), F.lit(False))).alias("n_missing_differs"),
                            F.count_if(F.abs(back - F.col(k)) > step * 0.5000001).alias("n_too_far")))
    return df.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def category_counts(df: DataFrame, cat: str, codes: int = 8) -> DataFrame:
    """code, n for all codes 0..codes-1; null counts as 0."""
    found = df.groupBy(F.coalesce(F.col(cat), F.lit(0)).cast("int").alias("code")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(codes).select(F.col("id").cast("int").alias("code"))
    return every.join(found, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))


def order_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def permuted(df: DataFrame, key: str, seed: int, rank: str = "rid") -> DataFrame:
    """df with a rank in a seeded random order: any prefix of ranks is a uniform sample. No single-task sort."""
    return ranked(df, [order_key(F.col(key), seed)], rank, "permuted")


def prefix_sample(df: DataFrame, key: str, seed: int, k: int) -> DataFrame:
    """The first k rows of the seeded order: a top-k, without ranking all rows."""
    return df.orderBy(order_key(F.col(key), seed)).limit(k)


def budget_sample(df: DataFrame, key: str, seed: int, protected: Column, budget: int) -> DataFrame:
    """All protected rows and the first of the others in the seeded order, ``budget`` rows in all (protected rows are always kept)."""
    kept = df.where(protected)
    room = max(0, budget - kept.count())
    rest = ranked(df.where(~F.coalesce(protected, F.lit(False))), [order_key(F.col(key), seed)], "_place", "budget")
    return kept.unionByName(rest.where(F.col("_place") < room).drop("_place"))


def stride_sample(df: DataFrame, rank: str, step: int) -> DataFrame:
    return df.where(F.col(rank) % step == 0)


def manifest(df: DataFrame, dims: list[DimSpec], cats: list[CatSpec], stats: dict[str, tuple[float, float]]) -> str:
    """JSON of an export: its rows, dimensions (with their quantiles) and categories (with counts); a few kilobytes."""
    q: dict[str, list[float]] = {}
    for r in quantile_table(df, [d.key for d in dims]).orderBy("dim", "k").collect():
        q.setdefault(r["dim"], []).append(float(f"{r['q']:.6g}"))
    out = {"n": df.count(), "dims": [{"key": d.key, "label": d.label, "unit": d.unit, "group": d.group, "min": d.low, "max": d.high, "center": stats[d.key][0], "scale": stats[d.key][1], "quantiles": q.get(d.key, [])} for d in dims], "categories": []}
    for c in cats:
        n = {r["code"]: r["n"] for r in category_counts(df, c.key).collect()}
        out["categories"].append({"key": c.key, "label": c.label, "nmissing": n[0], "codes": [{"code": k, "label": v, "n": n.get(k, 0)} for k, v in c.codes]})
    return json.dumps(out)


def carried_over(now: DataFrame, before: DataFrame, key: str, column: str, default: str = "") -> DataFrame:
    """now with a column from the previous build."""
    return now.join(before.select(key, column), key, "left").withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def monotonic_faults(df: DataFrame, group: str, rank: str, value: str) -> DataFrame:
    """group, faults: places where value falls."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(rank))
    return df.withColumn("_b", before).groupBy(group).agg(F.count_if(F.col(value) < F.col("_b")).alias("faults"))
