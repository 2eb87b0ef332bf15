"""A view as columns: projection with fading of missing dimensions, filters, selections."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismview.functions.scalars import clamp, inside_polygon, standardized
from prismview.spec import ViewSpec

FADE_LIMIT, LEAST_FADE, SHOWN = 0.12, 0.01, 128


def axis(weights: tuple[tuple[str, float], ...], stats: dict[str, tuple[float, float]]) -> Column:
    """Sum of weight times standardized value, a missing value counting as 0; terms of weight 0 aren't emitted."""
    terms = [F.lit(w) * F.coalesce(standardized(F.col(k), *stats[k]), F.lit(0.0)) for k, w in weights if w != 0]
    return reduce(lambda a, b: a + b, terms, F.lit(0.0)) if not terms else reduce(lambda a, b: a + b, terms)


def visibility(view: ViewSpec) -> Column:
    """0, or 1..255: the product over missing dimensions of 1 - weight / limit; below a hundredth it is 0."""
    x, y = dict(view.x), dict(view.y)
    fade = F.lit(1.0)
    for k in dict.fromkeys([*x, *y]):
        f = min(1.0, max(0.0, 1 - math.sqrt(x.get(k, 0.0) ** 2 + y.get(k, 0.0) ** 2) / FADE_LIMIT))
        if f < 1:
            fade = fade * F.when(F.col(k).isNull(), F.lit(f)).otherwise(F.lit(1.0))
    return F.when(fade < LEAST_FADE, 0).otherwise(F.greatest(F.lit(1), F.round(255 * fade).cast("int")))


def filters(view: ViewSpec) -> list[Column]:
    """The view's predicates on physical columns, so that they reach the scan: ranges, codes, required dimensions."""
    out = [F.col(k).between(a, b) for k, a, b in view.ranges]
    out += [F.coalesce(F.col(k), F.lit(0)).isin(list(codes)) if 0 in codes else F.col(k).isin(list(codes)) for k, codes in view.masks]
    return out + [F.col(k).isNotNull() for k in view.need]


def projected(df: DataFrame, view: ViewSpec, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """df with X, Y, vis; rows that a filter excludes are gone, rows that fade out have vis 0."""
    kept = reduce(lambda d, f: d.where(f), filters(view), df)
    return kept.withColumns({"X": axis(view.x, stats), "Y": axis(view.y, stats), "vis": visibility(view)})


def project_vector(df: DataFrame, vector: str, px: list[float], py: list[float]) -> DataFrame:
    """Projection of an array column: one fold per axis instead of a term per dimension."""
    fold = lambda p: F.aggregate(F.zip_with(F.col(vector), F.array(*[F.lit(float(w)) for w in p]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    return df.withColumns({"X": fold(px), "Y": fold(py)})


def color_value(df_col: Column, lo: float, hi: float) -> Column:
    """0..1 along a colour range; reversed where hi < lo."""
    return clamp((df_col - lo) / (hi - lo), 0.0, 1.0)


def color_range(q: list[float], given: tuple[float, float] | None = None) -> tuple[float, float]:
    """A given range if it covers over a quarter of the 1-99 % span of the quantiles, else the 2-98 % span."""
    if given:
        overlap = min(max(given), q[99]) - max(min(given), q[1])
        if q[99] > q[1] and overlap / (q[99] - q[1]) > 0.25:
            return given
    return q[2], q[98]


def shown(df: DataFrame) -> DataFrame:
    return df.where(F.col("vis") >= SHOWN)


def lasso(df: DataFrame, vertices: list[tuple[float, float]]) -> DataFrame:
    """Shown rows inside a polygon of the view."""
    return shown(df).where(inside_polygon(F.col("X"), F.col("Y"), vertices))


def combine_selection(now: DataFrame | None, new: DataFrame, key: str, mode: str) -> DataFrame:
    """Key sets: replace, add or subtract."""
    if mode == "replace" or (now is None and mode == "add"):
        return new.select(key).distinct()
    if now is None:
        return new.select(key).limit(0)
    return now.select(key).union(new.select(key)).distinct() if mode == "add" else now.select(key).join(new.select(key), key, "left_anti")


def bit_filter(df: DataFrame, column: str, bits: int) -> DataFrame:
    return df.where(F.col(column).bitwiseAND(F.lit(bits)) > 0)
