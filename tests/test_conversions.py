import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismview.operators import conversions as cv
from prismview.operators import galaxies, relations
from prismview.spec import ViewSpec


def test_bisection_of_columns(spark):
    rows = [(8.0,), (27.0,), (0.0,), (None,), (float("nan"),), (float("inf"),)]
    x = F.col("x")
    got = [r[0] for r in spark.createDataFrame(rows, "x double").select(cv.bisected(lambda u: u * u * u - x, x * 0, x + 1)).collect()]
    assert got[0] == pytest.approx(2) and got[1] == pytest.approx(3) and got[2] == pytest.approx(0, abs=1e-9) and got[3:] == [None] * 3
    ends = spark.range(1).select(cv.bisected(lambda u: u + 5, F.lit(0.0), F.lit(1.0)), cv.bisected(lambda u: u - 5, F.lit(0.0), F.lit(1.0))).first()
    assert ends[0] == pytest.approx(0) and ends[1] == pytest.approx(1)  # no crossing: the nearer end


def test_chords(spark):
    for f in (lambda u: u * u * u - 2, lambda u: u ** 5 + u - 1.5, lambda u: 3 * u - 4):
        want = cv.bisected(f, np.array([0.0]), np.array([2.0]))[0]
        assert cv.crossed(f, np.array([0.0]), np.array([2.0]))[0] == pytest.approx(want, abs=1e-9)
        assert spark.range(1).select(cv.crossed(f, F.lit(0.0), F.lit(2.0))).first()[0] == pytest.approx(want, abs=1e-9)
    x = F.col("x")
    got = [r[0] for r in spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-7.0,), (9.0,), (0.0,)], "x double").select(cv.crossed(lambda u: u - x, x * 0, x * 0 + 1)).collect()]
    assert got == [None, None, None, 0.0, 1.0, 0.0]


@pytest.mark.parametrize("halo", [cv.Halo("200c", 0.704, 0.272), cv.Halo("vir", 0.7, 0.27)])
def test_halo_masses(spark, halo):
    lm = np.linspace(10.5, 15, 19)
    wide = halo.to_mean(lm)
    assert np.allclose(halo.from_mean(wide), lm, atol=1e-9) and (wide > lm).all()
    # the mean densities within the two radii differ by the ratio of the contrasts
    c = halo.concentration(lm)
    x = c * 10 ** ((wide - lm - math.log10(halo.thinner())) / 3)
    assert np.allclose(cv.enclosed(x) / x ** 3, halo.thinner() * cv.enclosed(c) / c ** 3)
    m = F.col("m")
    got = spark.createDataFrame([(float(v),) for v in lm], "m double").select("m", halo.to_mean(m).alias("w")).select("m", "w", halo.from_mean(F.col("w")).alias("b")).orderBy("m").collect()
    assert np.allclose([r["w"] for r in got], wide) and np.allclose([r["b"] for r in got], lm)


def test_incomplete_gamma(spark):
    x = np.array([1e-6, 0.5, 2.0, 10.0, 80.0])
    one, two = cv.incomplete_gamma(x * 0 + 1, x), cv.incomplete_gamma(x * 0 + 2, x)
    assert np.allclose(one, 1 - np.exp(-x), atol=1e-12) and np.allclose(two, 1 - np.exp(-x) * (1 + x), atol=1e-12)
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select(cv.incomplete_gamma(F.col("x") * 0 + 2, F.col("x"))).collect()
    assert np.allclose([r[0] for r in got], two, atol=1e-12)
    a = np.array([0.5, 3.0, 7.5, 16.0])
    assert np.allclose(cv._log_gamma(a), [math.lgamma(v) for v in a], atol=1e-10)


def test_profiles(spark):
    got = {r["n"]: r for r in cv.profile_constants(spark.createDataFrame([(4.0,), (1.0,), (4.0,), (None,), (-1.0,), (9.0,)], "n double"), "n").collect()}
    assert set(got) == {1.0, 4.0} and got[4.0]["b"] == pytest.approx(7.669249) and got[1.0]["b"] == pytest.approx(1.678347)
    assert got[4.0]["half"] == pytest.approx(0.713, abs=1e-3) and got[4.0]["share"] == pytest.approx(0.816, abs=1e-3)  # as published
    assert cv.aperture_share(1.0) == pytest.approx(got[1.0]["share"])


def test_converted_relations(spark):
    assert relations.unknown_references(galaxies.PRESETS) == set()
    r = relations.RELATIONS
    pts = {i: [(p["ax"], p["ay"]) for p in relations.points(spark, r[i]).orderBy("k").collect()] for i in ("Mo13", "H12", "C18", "S03L", "S03E", "K03S")}
    assert all(v in pts["C18"] for v in relations.GAS_MEDIANS)
    assert len({x for x, _ in pts["K03S"]}) == 1 and pts["K03S"][0][0] == pytest.approx(8.42, abs=0.005)
    assert dict(pts["S03E"])[10.0] == pytest.approx(0.56 * 10 + math.log10(2.88e-6) + 0.024 - 0.02, abs=0.01)
    assert all(b >= a for (_, a), (_, b) in zip(pts["S03L"], pts["S03L"][1:], strict=False))
    # the ends of the range are the source's ends brought to our scale, so their values are the source's own
    f = relations.halo_fraction(0.1)
    at = lambda m: m + math.log10(2 * f[0] / (10 ** (-f[2] * (m - f[1])) + 10 ** (f[3] * (m - f[1]))))
    assert pts["Mo13"][0][1] == pytest.approx(at(11.0) + relations.HEAVIER + 2 * relations.PER_H, abs=2e-3) and pts["Mo13"][-1][1] == pytest.approx(at(15.0) + relations.HEAVIER + 2 * relations.PER_H, abs=2e-3)
    upright = spark.createDataFrame([(9.0, -11.0), (None, -11.0)], "logSigma double, logsSFR double").select(relations.residual(r["K03S"]).alias("v")).collect()
    assert upright[0]["v"] == pytest.approx(9 - relations.DENSE) and upright[1]["v"] is None


def test_axes_swap():
    v = ViewSpec((("a", 0.6), ("b", 0.8)), (("c", 1.0),))
    assert v.with_axis("x", "a") == ViewSpec((("a", 1.0),), (("c", 1.0),))
    swapped = v.with_axis("x", "c")
    assert swapped.x == (("c", 1.0),) and swapped.y == v.x
    near = ViewSpec((("a", 1.0),), (("c", 0.95), ("a", 0.1)))
    assert near.with_axis("x", "c") == ViewSpec((("c", 1.0),), (("a", 1.0),))
    with pytest.raises(ValueError):
        v.with_axis("z", "a")
