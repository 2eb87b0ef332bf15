"""Reading discipline: deduplication with a defined order, joins whose cardinality is enforced, staged matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    pass


def require_unique(df: DataFrame, keys: list[str], what: str = "right side") -> DataFrame:
    """df, after a check that no key occurs twice (one combined aggregate)."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).count()
    if twice:
        raise CardinalityError(f"{what}: keys {keys} aren't unique")
    return df


def left_many_to_one(left: DataFrame, right: DataFrame, keys: list[str], complete: bool = False) -> DataFrame:
    """Left join on keys that are unique on the right; complete: every left row must find a partner."""
    require_unique(right, keys)
    if complete and left.join(right, keys, "left_anti").limit(1).count():
        raise CardinalityError(f"left rows without a partner by {keys}")
    return left.join(right, keys, "left")


def left_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    require_unique(left, keys, "left side")
    return left_many_to_one(left, right, keys)


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n > 1").drop("_n")


def repeat_spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: groups with repeats, median and largest range of value within a group."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(value) - F.min(value)).alias("spread")).where("n > 1")
    return g.agg(F.count("*").alias("n_groups"), F.median("spread").alias("median_spread"), F.max("spread").alias("max_spread"))


def staged_match(left: DataFrame, stages: list[tuple[str, DataFrame, list[str], list[Column]]], values: list[str]) -> DataFrame:
    """left with values and ``matched_by``: the first stage whose key finds a row wins.

    stages: (name, right, keys, order); right is reduced to the first row per key in that order.
    """
    out, hits = left, []
    for name, right, keys, order in stages:
        one = keep_best(right, keys, order).select(*keys, *[F.col(v).alias(f"_{name}_{v}") for v in values], F.lit(True).alias(f"_{name}"))
        out = out.join(one, keys, "left")
        hits.append(name)
    by = F.coalesce(*[F.when(F.col(f"_{n}"), n) for n in hits])
    pick = lambda v: reduce(lambda acc, n: F.when(F.col(f"_{n}"), F.col(f"_{n}_{v}")).otherwise(acc), reversed(hits), F.lit(None))
    return out.select(*left.columns, *[pick(v).alias(v) for v in values], by.alias("matched_by"))


def cut_report(df: DataFrame, cuts: list[tuple[str, Column]]) -> DataFrame:
    """One row: rows in, rows after each cut in turn, in a single pass."""
    passed, aggs = F.lit(True), [F.count("*").alias("n_in")]
    for name, ok in cuts:
        passed = passed & F.coalesce(ok, F.lit(False))
        aggs.append(F.count_if(passed).alias(f"n_{name}"))
    return df.agg(*aggs)


def range_report(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """dim, n_missing, n_below, n_above, n_valid for each dimension, in one pass."""
    aggs = []
    for k, (lo, hi) in ranges.items():
        c = F.col(k)
        aggs.append(F.struct(F.lit(k).alias("dim"), F.count_if(c.isNull()).alias("n_missing"), F.count_if(c < lo).alias("n_below"), F.count_if(c > hi).alias("n_above"), F.count_if(c.between(lo, hi)).alias("n_valid")))
    return df.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")
