import math

import pytest

from prismview.functions import cosmology
from prismview.operators import galaxies, relations

BASE = dict(objid="123456789012345678", plate=1, mjd=2, fiber=3, z=0.1, log_mstar=10.5, r_petro_corr=17.0, sn_median=10.0, log_sfr=0.5, log_ssfr=-10.0, d4000_n=1.4, d4000_n_err=0.1, hdelta_a=2.0, hdelta_a_err=0.1,
            gr_fit=0.6, gr_chi2=10.0, oh=8.9, f_nii=40.0, e_nii=1.0, f_ha=100.0, e_ha=1.0, f_oiii=20.0, e_oiii=1.0, f_hb=30.0, e_hb=1.0, bptclass=1, petroR50_r=3.0, petroR90_r=7.5, fracDeV_r=0.2, expAB_r=0.7, deVAB_r=0.6,
            gz1_p_el_debiased=0.1, v_disp=120.0, v_disp_err=6.0, log_fgas=-0.5, lim_logMh_h=12.0, tauv_cont=0.3, lim_nmem=2, lim_galaxy_id=5, lim_cen_id=5, gz1_match="a", gz1_elliptical=0, gz1_spiral=1, gz1_uncertain=0)


def rows(spark, *changes):
    from pyspark.sql import Row
    import pyspark.sql.types as T

    kinds = {str: T.StringType(), int: T.IntegerType(), float: T.DoubleType()}
    schema = T.StructType([T.StructField(k, kinds[type(v)]) for k, v in BASE.items()])
    return spark.createDataFrame([Row(**(BASE | c)) for c in changes], schema)


def test_dimensions_and_categories(spark):
    r = galaxies.derived(rows(spark, {})).first()
    kpc = 3.0 * cosmology.kpc_per_arcsec(0.1)
    n2, o3 = math.log10(0.4), math.log10(20 / 30)
    want = {"logM": 10.5, "D4000": 1.4, "gr": 0.6, "OH_PP04": 8.73 - 0.32 * (o3 - n2), "C": 2.5, "logSigma": 10.5 - math.log10(2 * math.pi * kpc ** 2), "ba": 0.7,
            "logSigV": math.log10(120 * (1.5 / (3 / 8)) ** 0.04), "mu50": 17 + 2.5 * math.log10(2 * math.pi * 9) - 10 * math.log10(1.1), "logMh": 12 - math.log10(0.7), "N2Ha": n2, "O3Hb": o3, "AV": 0.32571, "HaHb": math.log10(100 / 30), "z": 0.1}
    for k, v in want.items():
        assert r[k] == pytest.approx(v, abs=1e-4), k
    assert (r["bpt"], r["env"], r["morph"]) == (1, 2, 2)


def test_missing_and_sentinels(spark):
    nan = float("nan")
    got = galaxies.derived(rows(spark, dict(petroR50_r=-9999.0, v_disp=20.0, d4000_n_err=0.0, gr_chi2=301.0, fracDeV_r=nan, oh=-9999.0, tauv_cont=-9999.0, f_nii=-1.0),
                                dict(bptclass=4, f_oiii=900.0), dict(bptclass=4, e_hb=0.0, lim_galaxy_id=6, gz1_uncertain=1), dict(bptclass=-1, lim_nmem=None, gz1_match=""))).collect()
    assert all(got[0][k] is None for k in ("logR50", "C", "logSigma", "mu50", "logSigV", "D4000", "gr", "ba", "OH", "AV", "N2Ha", "OH_PP04"))
    assert [r["bpt"] for r in got[1:]] == [4, 5, 7] and [r["env"] for r in got[1:]] == [2, 3, 0] and [r["morph"] for r in got[1:]] == [2, 3, 0]


def test_cuts_keep_the_best_spectrum(spark):
    df = rows(spark, {}, dict(sn_median=20.0, plate=9), dict(objid="2", z=0.4), dict(objid="3", log_mstar=float("nan")), dict(objid="4", r_petro_corr=17.78))
    assert [(r["objid"], r["plate"]) for r in galaxies.cuts(df).collect()] == [(BASE["objid"], 9)]


def test_relations(spark):
    pts = {i: {r["ax"]: r["ay"] for r in relations.points(spark, relations.RELATIONS[i]).collect()} for i in ("T04", "AM13", "RP15", "K03", "Mo13", "B13")}
    assert pts["T04"][10.0] == pytest.approx(-1.492 + 18.47 - 8.026, abs=1e-3) and pts["RP15"][8.5] == pytest.approx(-1.18)
    near = lambda i, x: min(pts[i].items(), key=lambda p: abs(p[0] - x))[1]
    assert near("Mo13", 12.0) == pytest.approx(near("B13", 12.0), abs=0.25) and 10.2 < near("Mo13", 12.0) < 10.8
    d = galaxies.derived(rows(spark, *[dict(log_mstar=9 + i / 40, objid=str(i)) for i in range(60)]))
    got = {r["id"]: r for r in relations.median_residuals(d, ["T04", "RP15"], 10).collect()}
    assert got["T04"]["n"] == 60 and got["RP15"]["n"] == 60
    left = relations.unknown_references(galaxies.PRESETS)
    assert left == set()


def test_presets_are_unit_vectors():
    v = galaxies.preset("fp", {d.key: 0.5 for d in galaxies.DIMS})
    assert sum(w * w for _, w in v.x) == pytest.approx(1) and v.masks == (("morph", (1,)),)
