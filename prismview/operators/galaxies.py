"""The galaxy catalog: cuts, 22 derived dimensions and 3 categories from joined input tables, as columns of one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismview.functions.cosmology import kpc_per_arcsec_column
from prismview.functions.scalars import finite_within, in_range, log_ratio, one_of_flags, signal_to_noise
from prismview.operators.ingest import keep_best
from prismview.spec import CatSpec, DimSpec, ViewSpec

#: Cuts and published constants.
Z_CUT, MASS_CUT, FLUX_CUT = (0.005, 0.30), 6.0, 17.77
ERROR_SCALE = {"hb": 1.882, "oiii": 1.566, "ha": 2.473, "nii": 2.039}
LEAST_SN, COLOR_CHI2, TAU_TO_A, H = 3.0, 300.0, 1.0857, 0.7
O3N2_RANGE, O3N2_LINE = (-1.0, 1.9), (8.73, -0.32)
SEYFERT_LINE = (1.05, 0.45)
DISPERSION, FIBER_RADIUS, APERTURE_POWER = (40.0, 500.0, 0.3), 1.5, 0.04
_D = (("logM", "stars", 7, 12.5), ("logSFR", "sf", -4, 2.5), ("logsSFR", "sf", -14, -8), ("D4000", "stars", 0.8, 2.6), ("HdA", "stars", -6, 12), ("gr", "stars", -0.2, 1.4),
      ("OH", "chem", 7.6, 9.5), ("OH_PP04", "chem", 7.8, 9.2), ("logR50", "struct", -1, 2), ("C", "struct", 1.2, 4.5), ("logSigma", "struct", 5.5, 11), ("ba", "struct", 0, 1),
      ("pEl", "struct", 0, 1), ("logSigV", "kin", 1.3, 2.8), ("mu50", "struct", 16, 26), ("logfHI", "gas", -3, 2.5), ("logMh", "env", 10, 15.5), ("N2Ha", "lines", -2.5, 1),
      ("O3Hb", "lines", -1.5, 1.5), ("z", "obs", 0, 0.3), ("AV", "dust", -1, 4), ("HaHb", "dust", 0.2, 1.2))
DIMS = tuple(DimSpec(k, k, float(lo), float(hi), group=g) for k, g, lo, hi in _D)
CATS = (CatSpec("bpt", "emission-line class", ((1, "star-forming"), (2, "low S/N star-forming"), (3, "composite"), (4, "Seyfert"), (5, "LINER"), (6, "low S/N LINER"), (7, "unclassified"))),
        CatSpec("env", "environment", ((1, "isolated"), (2, "central"), (3, "satellite"))),
        CatSpec("morph", "morphology", ((1, "elliptical"), (2, "spiral"), (3, "uncertain"))))
#: The named views: (x, y, colour, masks, relations).
PRESETS = {
    "mzr": ({"logM": 1}, {"OH": 1}, "logSFR", {}, ("T04",)), "mzr2": ({"logM": 1}, {"OH_PP04": 1}, "logSFR", {}, ("KE08", "AM13", "C20")),
    "fmr": ({"logM": 1, "logSFR": -0.32}, {"OH_PP04": 1}, "logSFR", {}, ("M10",)), "sfms": ({"logM": 1}, {"logSFR": 1}, "D4000", {}, ("RP15", "S14", "S16", "Q11")),
    "ssfr": ({"logM": 1}, {"logsSFR": 1}, "env", {}, ("RP15s", "Q11s")), "cmr": ({"logM": 1}, {"gr": 1}, "logsSFR", {}, ()),
    "size": ({"logM": 1}, {"logR50": 1}, "C", {}, ("S03L", "S03E")), "sigma": ({"logSigma": 1}, {"logsSFR": 1}, "logM", {}, ("K03S", "Q11d")),
    "fp": ({"logSigV": 1.49, "mu50": 0.30}, {"logR50": 1}, "D4000", {"morph": (1,)}, ("B03",)), "bpt": ({"N2Ha": 1}, {"O3Hb": 1}, "bpt", {}, ("K03", "K01", "S07")),
    "shmr": ({"logMh": 1}, {"logM": 1}, "logsSFR", {"env": (1, 2)}, ("Mo13", "B13")), "env": ({"logMh": 1}, {"logsSFR": 1}, "env", {}, ("Q11e",)),
    "hi": ({"logM": 1}, {"logfHI": 1}, "logsSFR", {}, ("C18", "H12")), "d4k": ({"D4000": 1}, {"HdA": 1}, "logsSFR", {}, ()),
}


def preset(name: str, scales: dict[str, float]) -> ViewSpec:
    """A named view over standardized dimensions; scales: physical units of one standard unit."""
    x, y, color, masks, _ = PRESETS[name]
    unit = lambda c: tuple((k, w * scales[k] / sum((v * scales[j]) ** 2 for j, v in c.items()) ** 0.5) for k, w in c.items())
    return ViewSpec(unit(x), unit(y), color, masks=tuple(masks.items()))


def cuts(df: DataFrame) -> DataFrame:
    """Redshift in its closed range, mass above its bound, corrected flux up to its bound, then the spectrum of the highest
    signal per object; ties go to the smaller plate, mjd, fiber."""
    ok = in_range(F.col("z"), *Z_CUT).isNotNull() & finite_within(F.col("log_mstar"), MASS_CUT).isNotNull() & (finite_within(F.col("r_petro_corr")) <= FLUX_CUT)
    return keep_best(df.where(ok), ["objid"], [F.col("sn_median").desc_nulls_last(), F.col("plate"), F.col("mjd"), F.col("fiber")])


def line_ratio(a: str, b: str) -> Column:
    sn = [signal_to_noise(F.col(f"f_{k}"), F.col(f"e_{k}"), ERROR_SCALE[k]) > LEAST_SN for k in (a, b)]
    return log_ratio(F.col(f"f_{a}"), F.col(f"f_{b}"), sn[0] & sn[1])


def dimensions(df: DataFrame) -> dict[str, Column]:
    """The 22 dimensions before their range rule."""
    c, fin = F.col, finite_within
    n2, o3 = line_ratio("nii", "ha"), line_ratio("oiii", "hb")
    o3n2 = o3 - n2
    r50, r90 = fin(c("petroR50_r"), 0.0), fin(c("petroR90_r"), 0.0)
    kpc = r50 * kpc_per_arcsec_column(c("z"))
    lo, hi, part = DISPERSION
    v, e = c("v_disp"), c("v_disp_err")
    good_v = (v > lo) & (v < hi) & (e > 0) & (e < part * v) & r50.isNotNull()
    two_pi = 6.283185307179586
    return {
        "logM": fin(c("log_mstar")), "logSFR": fin(c("log_sfr")), "logsSFR": fin(c("log_ssfr")),
        "D4000": F.when(c("d4000_n_err") > 0, fin(c("d4000_n"))), "HdA": F.when(c("hdelta_a_err") > 0, fin(c("hdelta_a"))),
        "gr": F.when(c("gr_chi2") <= COLOR_CHI2, fin(c("gr_fit"))), "OH": fin(c("oh")),
        "OH_PP04": F.when((c("bptclass") == 1) & (o3n2 > O3N2_RANGE[0]) & (o3n2 < O3N2_RANGE[1]), O3N2_LINE[0] + O3N2_LINE[1] * o3n2),
        "logR50": F.log10(kpc), "C": r90 / r50, "logSigma": fin(c("log_mstar")) - F.log10(two_pi * kpc * kpc),
        "ba": F.when(c("fracDeV_r") < 0.5, c("expAB_r")).when(fin(c("fracDeV_r")).isNotNull(), c("deVAB_r")), "pEl": fin(c("gz1_p_el_debiased"), -1.0),
        "logSigV": F.when(good_v, F.log10(v * F.pow(FIBER_RADIUS / (r50 / 8.0), F.lit(APERTURE_POWER)))),
        "mu50": c("r_petro_corr") + 2.5 * F.log10(two_pi * r50 * r50) - 10 * F.log10(1 + c("z")),
        "logfHI": fin(c("log_fgas")), "logMh": fin(c("lim_logMh_h")) - F.log10(F.lit(H)), "N2Ha": n2, "O3Hb": o3, "z": c("z"),
        "AV": TAU_TO_A * fin(c("tauv_cont"), -1000.0), "HaHb": line_ratio("ha", "hb"),
    }


def categories() -> dict[str, Column]:
    """bpt, env, morph; 0 is missing."""
    c = F.col
    n2 = F.coalesce(line_ratio("nii", "ha"), log_ratio(c("f_nii"), c("f_ha")))
    o3 = F.coalesce(line_ratio("oiii", "hb"), log_ratio(c("f_oiii"), c("f_hb")))
    four = F.when(n2.isNull() | o3.isNull(), 7).when(o3 > SEYFERT_LINE[0] * n2 + SEYFERT_LINE[1], 4).otherwise(5)
    bpt = F.when(c("bptclass").isin(1, 2, 3), c("bptclass").cast("int")).when(c("bptclass") == 4, four).when(c("bptclass") == 5, 6).when(c("bptclass") == -1, 7).otherwise(0)
    central = c("lim_galaxy_id").eqNullSafe(c("lim_cen_id")) & c("lim_galaxy_id").isNotNull()
    env = F.when(c("lim_nmem") == 1, 1).when((c("lim_nmem") >= 2) & central, 2).when(c("lim_nmem") >= 2, 3).otherwise(0)
    voted = F.coalesce(c("gz1_match"), F.lit("")) != ""
    flag = one_of_flags([(c("gz1_elliptical") == 1, 1), (c("gz1_spiral") == 1, 2), (c("gz1_uncertain") == 1, 3)])
    return {"bpt": bpt, "env": env, "morph": F.when(~voted, 0).when(flag == 0, 3).otherwise(flag)}


def derived(df: DataFrame) -> DataFrame:
    """df with the 22 dimensions (null outside their closed ranges) and the 3 categories. Columns of the same names are replaced
    by their own derivation, so all expressions see the input."""
    made = dimensions(df)
    columns = [in_range(made[d.key], d.low, d.high).alias(d.key) for d in DIMS] + [v.alias(k) for k, v in categories().items()]
    names = {k.lower() for k in [*(d.key for d in DIMS), *categories()]}  # names are compared without case
    return df.select(*[c for c in df.columns if c.lower() not in names], *columns)


def complete(df: DataFrame, dims: list[str]) -> DataFrame:
    return reduce(lambda d, k: d.where(F.col(k).isNotNull()), dims, df)
