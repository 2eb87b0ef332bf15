"""Published relations between the galaxy dimensions: formula, axes, range. Curves are a few dozen points."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismview.functions.quantiles import group_median
from prismview.functions.scalars import interpolated
from prismview.functions.shared import IN_A_TASK
from prismview.operators import curves as cv
from prismview.operators.conversions import EARLY_SHARE, Halo, aperture_less_profile, aperture_share, once


@dataclass(frozen=True)
class Relation:
    id: str
    x: dict[str, float]
    y: dict[str, float]
    low: float
    high: float
    formula: Callable[[Column], Column] | None
    kind: str = "fit"
    fit_offset: bool = False
    nodes: tuple[tuple[float, float], ...] = ()  # of a polyline; of an upright threshold (no formula) its two ends


def halo_fraction(z: float) -> tuple[float, float, float, float]:
    """(norm, turn, beta, gamma) of the stellar-to-halo relation at redshift z."""
    f = z / (1 + z)
    return 0.0351 - 0.0247 * f, 11.590 + 1.195 * f, 1.376 - 0.826 * f, 0.608 + 0.329 * f


def halo_polynomial(x: Column, z: float) -> Column:
    """The relation with an exponential turn, at redshift z (x = log10 of the halo mass)."""
    a = 1 / (1 + z)
    nu = float(np.exp(-4 * a * a))
    eps = -1.777 - 0.006 * (a - 1) * nu - 0.119 * (a - 1)
    turn = 11.514 + (-1.793 * (a - 1) - 0.251 * z) * nu
    alpha, delta, gamma = -1.412 + 0.731 * (a - 1) * nu, 3.508 + (2.608 * (a - 1) - 0.043 * z) * nu, 0.316 + (1.319 * (a - 1) + 0.279 * z) * nu
    f = lambda u: -F.log10(F.pow(F.lit(10.0), alpha * u) + 1) + delta * F.pow(F.log10(1 + F.exp(u)), F.lit(gamma)) / (1 + F.exp(F.pow(F.lit(10.0), -u)))
    return eps + turn + f(x - turn) - f(F.lit(0.0))


AGE = 12.2  # Gyr at z = 0.1
#: Halo definitions of the two halo relations, and what brings their masses to ours. HEAVIER: stellar masses of one initial mass
#: function to those of the other; RED: log radius in the r band less that in the z band, of late and early types and of all.
MO13, B13 = Halo("200c", 0.704, 0.272), Halo("vir", 0.7, 0.27)
PER_H = math.log10(0.704 / 0.7)
HEAVIER = round(math.log10(0.66 / 0.61), 4)
RED = {"late": 0.029, "early": 0.024, "all": 0.027}
#: Medians of the gas fraction by mass.
GAS_MEDIANS = ((9.14, -0.092), (9.44, -0.320), (9.74, -0.656), (10.07, -0.854), (10.34, -1.278), (10.65, -1.223), (10.95, -1.707), (11.20, -1.785))
DENSE = math.log10(3e8) - 2 * RED["all"]


def mo13(x: Column) -> Column:
    """Stellar mass at our halo mass: brought to the source's definition, read there, and brought back."""
    return once(x - PER_H, lambda m: once(MO13.from_mean(m), lambda s: cv.double_power_fraction(s, *halo_fraction(0.1)))) + (HEAVIER + 2 * PER_H)


def b13(x: Column) -> Column:
    return once(x, lambda m: once(B13.from_mean(m), lambda s: halo_polynomial(s, 0.1))) + HEAVIER


def our_halo_range(halo: Halo, low: float, high: float, shift: float = 0.0) -> tuple[float, float]:
    """A range of the source's halo masses on our scale."""
    low, high = (halo.to_mean(np.array([low, high])) + shift).tolist()
    return low, high


def size(x: Column, early: bool) -> Column:
    """Median radius within the aperture in the r band, from the profile radius in the z band."""
    z_band = math.log10(2.88e-6) + 0.56 * x if early else math.log10(0.10) + 0.14 * x + (0.39 - 0.14) * F.log10(1 + F.pow(F.lit(10.0), x) / 3.98e10)
    r_band = z_band + RED["early" if early else "late"]
    return once(r_band, lambda r: r + aperture_less_profile(r, early, EARLY_SHARE if early else LATE_SHARE))


LATE_SHARE = aperture_share(1.0)
#: Coefficients and ranges as published, on our scales.
RELATIONS = {r.id: r for r in (
    Relation("T04", {"logM": 1}, {"OH": 1}, 8.5, 11.5, lambda x: cv.polynomial(x, [-1.492, 1.847, -0.08026])),
    Relation("KE08", {"logM": 1}, {"OH_PP04": 1}, 8.5, 11.0, lambda x: cv.polynomial(x, [32.1488, -8.51258, 0.976384, -0.0359763])),
    Relation("AM13", {"logM": 1}, {"OH_PP04": 1}, 7.4, 10.5, lambda x: cv.asymptotic(x, 8.798, 8.901, 0.640)),
    Relation("C20", {"logM": 1}, {"OH_PP04": 1}, 7.95, 11.85, lambda x: cv.broken_power(x, 8.793, 10.02, 0.28, 1.2)),
    Relation("M10", {"logM": 1, "logSFR": -0.32}, {"OH_PP04": 1}, 9.2, 11.4, lambda x: cv.polynomial(x - 10.0, [8.90, 0.39, -0.20, -0.077, 0.064]), fit_offset=True),
    Relation("RP15", {"logM": 1}, {"logSFR": 1}, 8.5, 11.0, lambda x: cv.line(x, 0.76, -7.64)),
    Relation("RP15s", {"logM": 1}, {"logsSFR": 1}, 8.5, 11.0, lambda x: cv.line(x, -0.24, -7.64)),
    Relation("S14", {"logM": 1}, {"logSFR": 1}, 9.7, 11.1, lambda x: cv.evolving_line(x, AGE, (0.84, 0.026), (6.51, 0.11))),
    Relation("S16", {"logM": 1}, {"logSFR": 1}, 8.0, 11.5, lambda x: cv.polynomial(x, [0.0, -2.332, 0.4156, -0.01828])),
    Relation("Q11", {"logM": 1}, {"logSFR": 1}, 7.0, 12.5, lambda x: cv.line(x, 1.0, -11.0), "threshold"),
    Relation("Q11s", {"logM": 1}, {"logsSFR": 1}, 7.0, 12.5, lambda x: x * 0 - 11.0, "threshold"),
    Relation("Q11e", {"logMh": 1}, {"logsSFR": 1}, 10.0, 15.5, lambda x: x * 0 - 11.0, "threshold"),
    Relation("Q11d", {"logSigma": 1}, {"logsSFR": 1}, 5.5, 11.0, lambda x: x * 0 - 11.0, "threshold"),
    Relation("B03", {"logSigV": 1.49, "mu50": 0.30}, {"logR50": 1}, 8.5, 10.2, lambda x: cv.line(x, 1.0, -8.778), fit_offset=True),
    Relation("K03", {"N2Ha": 1}, {"O3Hb": 1}, -2.5, 0.0, lambda x: cv.hyperbola(x, 0.61, 0.05, 1.3), "demarcation"),
    Relation("K01", {"N2Ha": 1}, {"O3Hb": 1}, -2.5, 0.4, lambda x: cv.hyperbola(x, 0.61, 0.47, 1.19), "demarcation"),
    Relation("S07", {"N2Ha": 1}, {"O3Hb": 1}, -0.184, 1.0, lambda x: cv.line(x, 1.05, 0.45), "demarcation"),
    Relation("Mo13", {"logMh": 1}, {"logM": 1}, *our_halo_range(MO13, 11.0, 15.0, PER_H), mo13),
    Relation("B13", {"logMh": 1}, {"logM": 1}, *our_halo_range(B13, 10.5, 15.0), b13),
    Relation("H12", {"logM": 1}, {"logfHI": 1}, 7.0 + HEAVIER, 11.25 + HEAVIER, lambda x: cv.two_piece(x - HEAVIER, 9.0, (0.712, 3.117), (0.276, 7.042)) - x),
    Relation("C18", {"logM": 1}, {"logfHI": 1}, 9.14, 11.20, lambda x: interpolated(list(GAS_MEDIANS), x), "median", nodes=GAS_MEDIANS),
    Relation("S03L", {"logM": 1}, {"logR50": 1}, 8.7, 11.8, lambda x: size(x, False)),
    Relation("S03E", {"logM": 1}, {"logR50": 1}, 10.0, 11.9, lambda x: size(x, True)),
    Relation("K03S", {"logSigma": 1}, {"logsSFR": 1}, DENSE, DENSE, None, "threshold", nodes=((DENSE, -14.0), (DENSE, -8.0))),
)}


def combined(combo: dict[str, float]) -> Column:
    out = None
    for k, w in combo.items():
        term = F.lit(float(w)) * F.col(k)
        out = term if out is None else out + term
    return out


def points(spark: SparkSession, relation: Relation, n: int = 61) -> DataFrame:
    """k, ax, ay: a relation sampled over its range, four decimals; a polyline's own nodes are among the points."""
    at = F.col("id") / (n - 1)
    if relation.formula is None:
        (x0, y0), (x1, y1) = relation.nodes
        return spark.range(n).select(F.col("id").alias("k"), F.round(x0 + at * (x1 - x0), 4).alias("ax"), F.round(y0 + at * (y1 - y0), 4).alias("ay"))
    x = F.round(F.least(relation.low + at * (relation.high - relation.low), F.lit(relation.high)), 4)
    k = spark.range(n).select(F.col("id").alias("k"), x.alias("ax"))
    if relation.nodes:
        every = sorted({round(relation.low + i / (n - 1) * (relation.high - relation.low), 4) for i in range(n)} | {float(v[0]) for v in relation.nodes})
        k = spark.createDataFrame(list(enumerate(every)), "k long, ax double")
    inside = F.greatest(F.least(F.col("ax"), F.lit(relation.high)), F.lit(relation.low))
    return k.select("k", "ax", F.round(relation.formula(inside), 4).alias("ay")).where("ay is not null")


def residual(relation: Relation) -> Column:
    """y less the relation, null outside its range; of an upright threshold x less the threshold."""
    x = combined(relation.x)
    if relation.formula is None:
        return x - F.lit(relation.low)
    return F.when(x.between(relation.low, relation.high), combined(relation.y) - relation.formula(x))


def median_residuals(df: DataFrame, ids: list[str] | None = None, least: int = 50, most: int = IN_A_TASK) -> DataFrame:
    """id, n, mid (0 below ``least`` rows) of every relation, in one pass."""
    rel = [RELATIONS[i] for i in (ids or RELATIONS)]
    each = df.select(F.explode(F.array(*[F.struct(F.lit(r.id).alias("id"), residual(r).cast("double").alias("r")) for r in rel])).alias("x")).select("x.*")
    mids = group_median(each, ["id"], "r", "m", most)
    every = df.sparkSession.createDataFrame([(r.id,) for r in rel], "id string")
    n = F.coalesce("n", F.lit(0))
    return every.join(F.broadcast(mids), "id", "left").select("id", n.alias("n"), F.when(n < least, F.lit(0.0)).otherwise(F.col("m")).alias("mid"))  # a row for each relation


def unknown_references(presets: dict, relations: dict[str, Relation] = RELATIONS) -> set[str]:
    """Relations that a view lists and that don't exist, or whose axes aren't the view's."""
    return {i for x, y, _, _, ids in presets.values() for i in ids if i not in relations or set(relations[i].x) != set(x) or set(relations[i].y) != set(y)}
