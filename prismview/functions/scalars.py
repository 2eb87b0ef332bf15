"""Scalar expressions: cleaning, derivation, encoding, classification. All are Column arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = 65534


def finite_within(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """x where it is finite and strictly between lo and hi, else null."""
    ok = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ok = ok & (x > lo) if lo is not None else ok
    return F.when(ok & (x < hi) if hi is not None else ok, x)


def in_range(x: Column, lo: float, hi: float) -> Column:
    """x where it lies in the closed range, else null; NaN is outside."""
    return F.when(~F.isnan(x) & x.between(lo, hi), x)


def signal_to_noise(flux: Column, error: Column, rescale: float = 1.0) -> Column:
    return F.coalesce(F.when(error > 0, flux / (error * rescale)), F.lit(0.0))


def log_ratio(num: Column, den: Column, ok: Column | None = None) -> Column:
    """log10(num / den) where both are positive (and ok holds), else null."""
    both = (num > 0) & (den > 0)
    return F.when(both if ok is None else both & ok, F.log10(num / F.nullif(den, F.lit(0.0))))


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    a, d = F.radians(lon), F.radians(lat)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def separation(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in degrees (haversine)."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def chord_to_angle(d: Column) -> Column:
    return 2 * F.asin(d / 2)


def significant(x: Column, digits: int = 6) -> Column:
    """x to so many digits; a tie in its shortest decimal form goes away from zero."""
    return F.format_string(f"%.{digits}g", x).cast("double")


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def aperture_corrected(x: Column, radius: Column, aperture: float, power: float) -> Column:
    """log10 of x scaled by (aperture / radius) ** power."""
    return F.when((x > 0) & (radius > 0), F.log10(x * F.pow(F.lit(aperture) / F.nullif(radius, F.lit(0.0)), F.lit(power))))


def quantized(x: Column, lo: float, hi: float) -> Column:
    """0 for missing or out of range, else 1 + the nearest of 65534 steps (ties to even)."""
    return F.when(x.between(lo, hi) & ~F.isnan(x), 1 + F.rint((x - lo) / (hi - lo) * LEVELS)).otherwise(0).cast("int")


def whole(x: Column) -> Column:
    """x rounded to a whole number, halves away from 0: as round(x), which goes by way of decimals and takes several times as long."""
    up = lambda v: F.floor(v) + F.when(v - F.floor(v) >= 0.5, 1).otherwise(0)
    return F.when(x < 0, -up(-x)).otherwise(up(x)).cast("long")


def decoded(code: Column, lo: float, hi: float) -> Column:
    return F.when(code > 0, lo + (code - 1) * ((hi - lo) / LEVELS))


def standardized(x: Column, center: float, scale: float) -> Column:
    return (x - F.lit(center)) / F.lit(scale)


def percentile_of(table: Column, x: Column) -> Column:
    """Percentile of x in an ascending table of quantiles at 0..n-1; in a run of equal values its middle; ends outside."""
    n = F.size(table)
    below, upto = F.size(F.filter(table, lambda v: v < x)), F.size(F.filter(table, lambda v: v <= x))
    lower, upper = F.get(table, below - 1), F.get(table, below)
    between = below - 1 + (x - lower) / F.nullif(upper - lower, F.lit(0.0))
    return F.when(x.isNull(), None).when(upto > below, (below + upto - 1) / 2.0).when(below == 0, F.lit(0.0)).when(below == n, (n - 1).cast("double")).otherwise(between)


def cdf_percentile(table: Column, x: Column) -> Column:
    """As percentile_of, but right-continuous: at a run of equal values it jumps to the run's end."""
    n = F.size(table)
    upto = F.size(F.filter(table, lambda v: v <= x))
    lower, upper = F.get(table, upto - 1), F.get(table, upto)
    return F.when(x.isNull(), None).when(upto == 0, F.lit(0.0)).when(upto == n, (n - 1).cast("double")).otherwise(upto - 1 + (x - lower) / F.nullif(upper - lower, F.lit(0.0)))


def code_interval(table: Column, code: Column, low: Column | float, step: Column | float) -> tuple[Column, Column]:
    """Percentiles (first, last) that a quantized code covers: half a step on either side of its value."""
    return cdf_percentile(table, low + (code - 1.5) * step), cdf_percentile(table, low + (code - 0.5) * step)


def value_at(table: Column, p: Column) -> Column:
    """Linear interpolation of a table of quantiles at percentile p (0..n-1)."""
    k = F.least(F.greatest(F.floor(p), F.lit(0)), F.size(table) - 2).cast("int")
    a, b = F.get(table, k), F.get(table, k + 1)
    return a + (b - a) * (F.least(F.greatest(p, F.lit(0.0)), (F.size(table) - 1).cast("double")) - k)


def one_of_flags(flags: list[tuple[Column, int]]) -> Column:
    """The code of the flag that holds if exactly one does, else 0."""
    count = reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f, _ in flags])
    chosen = reduce(lambda acc, fc: F.when(fc[0], fc[1]).otherwise(acc), reversed(flags), F.lit(0))
    return F.when(count == 1, chosen).otherwise(0)


def interpolated(points: list[tuple[float, float]], x: Column) -> Column:
    """Piecewise linear through the points (sorted by x first), null outside; for a few hundred points at most."""
    pts = sorted(p for p in points if p[0] == p[0] and p[1] == p[1])
    xs, ys = F.array(*[F.lit(float(p[0])) for p in pts]), F.array(*[F.lit(float(p[1])) for p in pts])
    k = F.least(F.size(F.filter(xs, lambda v: v <= x)), F.lit(len(pts) - 1)) - 1
    x0, x1, y0, y1 = F.get(xs, k), F.get(xs, k + 1), F.get(ys, k), F.get(ys, k + 1)
    return F.when(x.between(pts[0][0], pts[-1][0]), y0 + (y1 - y0) * ((x - x0) / F.nullif(x1 - x0, F.lit(0.0))))


def inside_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd rule, exact; the bounding box is tested first."""
    xs, ys = [v[0] for v in vertices], [v[1] for v in vertices]
    odd = F.lit(0)
    for (xa, ya), (xb, yb) in zip(vertices, vertices[1:] + vertices[:1], strict=True):
        if ya == yb:
            continue
        crosses = (F.lit(float(ya)) > y) != (F.lit(float(yb)) > y)
        odd = odd + F.when(crosses & (x < (xb - xa) * (y - ya) / (yb - ya) + xa), 1).otherwise(0)
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (odd % 2 == 1)
