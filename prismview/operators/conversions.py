"""Mass scales, radii and profile constants whose equations have no closed solution, solved per row.

Every function takes a column, or a NumPy array for the few numbers that a plan needs as literals. A column's equation is solved by a
fixed number of steps inside one expression, so it runs in the JVM and needs no shuffle. Null and infinite arguments give null.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Values = TypeVar("Values", Column, np.ndarray)
STEPS = 50


def _maths(x):
    return F if isinstance(x, Column) else np


def once(x: Values, f: Callable[[Values], Values]) -> Values:
    """f(x) with x worked out once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0)) if isinstance(x, Column) else f(x)


def bisected(f: Callable[[Values], Values], low: Values, high: Values, steps: int = STEPS) -> Values:
    """Where a rising f crosses zero between low and high; the nearer end where it doesn't."""
    if not isinstance(low, Column):
        low, high = np.array(low, dtype=float), np.array(high, dtype=float)
        for _ in range(steps):
            mid = (low + high) / 2
            above = f(mid) > 0
            low, high = np.where(above, low, mid), np.where(above, mid, high)
        return (low + high) / 2

    def halved(s: Column, _: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2
        return F.when(f(mid) > 0, F.struct(s["low"].alias("low"), mid.alias("high"))).otherwise(F.struct(mid.alias("low"), s["high"].alias("high")))

    bracket = F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), bracket, halved, lambda s: (s["low"] + s["high"]) / 2)
    finite = F.abs(low) + F.abs(high) < F.lit(float("inf"))  # false for NaN, null for null
    return F.when(finite, found)


def crossed(f: Callable[[Values], Values], low: Values, high: Values, steps: int = 14) -> Values:
    """As bisected, for smooth functions that are nearly straight between low and high: chords in place of halves, where an end that stays
    for a second step has its height halved. A few steps do what fifty halvings do."""
    if not isinstance(low, Column):
        low, high = np.array(low, dtype=float), np.array(high, dtype=float)
        below, above, side = f(low), f(high), np.zeros_like(low)
        outside = np.where(below >= 0, low, high)
        crossing = (below < 0) & (above > 0)
        for _ in range(steps):
            with np.errstate(divide="ignore", invalid="ignore"):
                x = np.where(above > below, low + (high - low) * (-below / (above - below)), low)
            y = f(x)
            up = y > 0
            above, below = np.where(up, y, np.where(side < 0, above / 2, above)), np.where(up, np.where(side > 0, below / 2, below), y)
            low, high, side = np.where(up, low, x), np.where(up, x, high), np.where(up, 1.0, -1.0)
        return np.where(crossing, np.where(np.abs(below) < np.abs(above), low, high), outside)

    names = ("low", "high", "below", "above", "side")
    state = lambda *values: F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])

    def chord(s: Column, _: Column) -> Column:
        at = s["low"] + F.when(s["above"] > s["below"], (s["high"] - s["low"]) * (-s["below"] / F.nullif(s["above"] - s["below"], F.lit(0.0)))).otherwise(0.0)
        point = F.transform(F.array(at), lambda x: F.struct(x.alias("x"), f(x).alias("y")))  # the function once a step
        return F.get(F.transform(point, lambda p: F.when(p["y"] > 0, state(s["low"], p["x"], F.when(s["side"] > 0, s["below"] / 2).otherwise(s["below"]), p["y"], F.lit(1.0)))
                                 .otherwise(state(p["x"], s["high"], p["y"], F.when(s["side"] < 0, s["above"] / 2).otherwise(s["above"]), F.lit(-1.0)))), F.lit(0))

    low, high = low.cast("double"), high.cast("double")
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state(low, high, f(low), f(high), F.lit(0.0)), chord, lambda s: F.when(F.abs(s["below"]) < F.abs(s["above"]), s["low"]).otherwise(s["high"]))
    finite = F.abs(low) + F.abs(high) < F.lit(float("inf"))
    return F.when(finite, F.when(f(low) >= 0, low).when(f(high) <= 0, high).otherwise(found))


# ---- haloes: a mass within one mean density from the mass within another ----------------------------------------------

#: Norm, slope in mass and slope in 1 + z of the concentration, by definition of the mass, and the pivot in solar masses / h.
CONCENTRATION = {"200c": (5.71, -0.084, -0.47), "vir": (7.85, -0.081, -0.71)}
PIVOT = 2e12


def enclosed(x: Values) -> Values:
    """Mass within x scale radii of a profile that falls as 1/x inside and 1/x^3 outside, up to a constant."""
    return _maths(x).log1p(x) - x / (1 + x)


@dataclass(frozen=True)
class Halo:
    """A definition of halo mass (200 times the critical density, or virial) in a flat universe, and 180 times the mean density."""

    kind: str
    h: float
    matter: float
    z: float = 0.1

    def matter_now(self) -> float:
        m = self.matter * (1 + self.z) ** 3
        return m / (m + 1 - self.matter)

    def contrast(self) -> float:
        """Mean density over the critical one within the radius that defines the mass."""
        x = self.matter_now() - 1
        return 200.0 if self.kind == "200c" else 18 * math.pi ** 2 + 82 * x - 39 * x * x

    def thinner(self) -> float:
        return 180 * self.matter_now() / self.contrast()

    def concentration(self, log_mass: Values) -> Values:
        norm, slope, evolution = CONCENTRATION[self.kind]
        return 10.0 ** (slope * (log_mass + math.log10(self.h / PIVOT))) * (norm * (1 + self.z) ** evolution)

    def to_mean(self, log_mass: Values) -> Values:
        """log10 of the mass within 180 times the mean density."""
        def solved(c):
            aim, middle = _maths(c).log10(enclosed(c) / c ** 3 * self.thinner()), _maths(c).log10(c)

            def excess(u):
                return once(10.0 ** u, lambda x: aim - _maths(x).log10(enclosed(x)) + 3 * u)  # the mean density falls outwards

            return once(10.0 ** crossed(excess, middle - 1, middle + 1), lambda x: log_mass + _maths(x).log10(enclosed(x) / enclosed(c)))

        return once(self.concentration(log_mass), solved)

    def from_mean(self, log_mean: Values) -> Values:
        """The inverse of to_mean: one equation in the unknown mass, since its radius and concentration follow from it."""
        shift = math.log10(self.thinner())

        def excess(lm):
            at = lambda c: once(c * 10.0 ** ((log_mean - lm - shift) / 3), lambda x: lm + _maths(c).log10(enclosed(x) / enclosed(c)) - log_mean)
            return once(self.concentration(lm), at)

        return crossed(excess, log_mean - 1, log_mean + 1)


# ---- profiles of light -------------------------------------------------------------------------------------------------

def _log_gamma(a: Values) -> Values:
    """ln of the gamma function for a > 0: Stirling's series eight places up, and back."""
    m, up = _maths(a), a + 8
    back = m.log(a)
    for k in range(1, 8):
        back = back + m.log(a + k)
    inverse = 1 / up
    return (up - 0.5) * m.log(up) - up + 0.5 * math.log(2 * math.pi) + inverse / 12 - inverse ** 3 / 360 + inverse ** 5 / 1260 - back


def incomplete_gamma(a: Values, x: Values, terms: int = 200) -> Values:
    """The regularised lower incomplete gamma function by its power series, which holds for x well below ``terms``; 1 for x above
    a + 20 + 8 sqrt(a), where what is left is below 1e-12. For a up to 16."""
    m = _maths(a)
    far = a + 20 + 8 * m.sqrt(a)
    if m is np:
        near = np.minimum(x, far)
        term = total = np.ones_like(near)
        for k in range(1, terms):
            term = term * near / (a + k)
            total = total + term
        return np.where(x >= far, 1.0, np.exp(a * np.log(np.maximum(near, 1e-300)) - near - _log_gamma(a + 1)) * total)
    near = F.least(x, far)

    def added(s: Column, k: Column) -> Column:
        term = s["term"] * near / (a + k)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms - 1)), one, added, lambda s: s["total"])
    return F.when(x >= far, 1.0).otherwise(F.exp(a * F.log(F.greatest(near, F.lit(1e-300))) - near - _log_gamma(a + 1)) * total)


def half_light(n: Values) -> Values:
    """b of the profile exp(-b r^(1/n)) in the plane: half of the light lies within radius 1."""
    return bisected(lambda b: incomplete_gamma(2 * n, b) - 0.5, n * 0 + 1e-3, 2 * n + 1)


def light(n: Values, b: Values, r: Values) -> Values:
    """Share of all light within r half-light radii."""
    return incomplete_gamma(2 * n, b * r ** (1 / n))


def ring_radius(n: Values, b: Values, level: float = 0.2, inner: float = 0.8, outer: float = 1.25) -> Values:
    """The radius at which a ring's brightness is ``level`` times the mean brightness inside."""
    area = outer ** 2 - inner ** 2

    def deficit(u):
        r = 10.0 ** u
        return level * area * light(n, b, r) - (light(n, b, r * outer) - light(n, b, r * inner))

    return 10.0 ** bisected(deficit, n * 0 + math.log10(0.05), n * 0 + math.log10(50.0), 40)


def aperture_share(n: float) -> float:
    """Share of all light within twice the ring radius, of one profile."""
    one = np.array([n])
    b = half_light(one)
    return float(light(one, b, 2 * ring_radius(one, b))[0])


def profile_constants(df: DataFrame, n: str) -> DataFrame:
    """n, b, ring, share, half of every different value of a column of profile indices (above 0, up to 8): solved once per value, each
    root in a step of its own, so that none is solved again within another."""
    d = df.select(F.col(n).cast("double").alias("n")).where("n > 0 and n <= 8").distinct()
    n = F.col("n")
    d = d.withColumn("b", half_light(n))
    d = d.withColumn("ring", ring_radius(n, F.col("b")))
    d = d.withColumn("share", light(n, F.col("b"), 2 * F.col("ring")))
    inside = lambda r: light(n, F.col("b"), r) - F.col("share") / 2
    return d.withColumn("half", bisected(inside, n * 0 + 1e-4, 2 * F.col("ring")))


# ---- radii: one survey's sizes to another's through their size-luminosity fits -----------------------------------------

@dataclass(frozen=True)
class SizeFit:
    """log10 of the radius at an absolute magnitude: slope and value of a line (early), and a line that steepens at a turn (late)."""

    a: float
    b: float
    alpha: float
    beta: float
    gamma: float
    turn: float

    def early(self, magnitude: Values) -> Values:
        return self.b - 0.4 * self.a * magnitude

    def late(self, magnitude: Values) -> Values:
        bend = _maths(magnitude).log10(1 + 10.0 ** (-0.4 * (magnitude - self.turn)))
        return self.gamma - 0.4 * self.alpha * magnitude + (self.beta - self.alpha) * bend


#: The published fits for radii within an aperture and for radii of a profile, and the share of light in the aperture of early types.
APERTURE_FIT = SizeFit(a=0.60, b=-4.63, alpha=0.21, beta=0.53, gamma=-1.31, turn=-20.52)
PROFILE_FIT = SizeFit(a=0.65, b=-5.06, alpha=0.26, beta=0.51, gamma=-1.71, turn=-20.91)
EARLY_SHARE = 0.80


def aperture_less_profile(log_radius: Values, early: bool, share: float) -> Values:
    """log10 of aperture radius over profile radius at the same object: the magnitude that the profile radius stands for is solved for, made
    fainter by the light outside the aperture, and read in the other fit."""
    return once(log_radius, lambda r: _aperture_less_profile(r, early, share))


def _aperture_less_profile(log_radius: Values, early: bool, share: float) -> Values:
    kind = "early" if early else "late"
    near, far = getattr(PROFILE_FIT, kind), getattr(APERTURE_FIT, kind)
    magnitude = crossed(lambda m: log_radius - near(m), log_radius * 0 - 27.0, log_radius * 0 - 12.0)  # fainter is smaller
    return once(magnitude - 2.5 * math.log10(share), far) - log_radius
