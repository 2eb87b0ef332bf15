"""More of the query catalog: cleaning and derived values, text, joins with enforced cardinality, robust fits, clusters, files.

Importing this module registers its queries in the same tables as ``catalog``."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismview.functions import scalars as s
from prismview.functions import text as tx
from prismview.functions.shared import dealt, scratch, settled, table
from prismview.operators import cluster, conversions, encode, ingest, polygons, project, relations, stats, trends
from prismview.plans.catalog import _DAYS, ORACLE_SQL, QUERIES, WITH, _days, query  # noqa: F401
from prismview.plans.facts import DIMS, RANGES, SEED, SQL, facts
from prismview.sources import acquire, columns, export, readers


def _six(**named) -> list:
    return [F.round(c, 6).alias(k) for k, c in named.items()]


# ---- cleaning and derived values -------------------------------------------------------------------------------------

@query("""SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_acctbal < 9000 THEN c_acctbal END AS strict, CASE WHEN c_acctbal BETWEEN 0 AND 9000 THEN c_acctbal END AS closed,
  round(CASE WHEN c_custkey % 7 > 1 THEN c_acctbal / ((c_custkey % 7 - 1) * 1.25::DOUBLE) ELSE 0 END, 6) AS sn,
  round(CASE WHEN c_acctbal > 0 AND c_custkey % 5 > 0 AND c_custkey % 3 > 0 THEN log10(c_acctbal / (c_custkey % 5)) END, 6) AS ratio,
  round(CASE WHEN c_acctbal > 0 AND c_custkey % 11 > 0 THEN log10(c_acctbal * pow(3.0::DOUBLE / (c_custkey % 11), 1.3::DOUBLE)) END, 6) AS corrected,
  format('{:.6g}', c_acctbal / 7)::DOUBLE AS short, least(greatest(c_acctbal, 0.0::DOUBLE), 5000.0::DOUBLE) AS clamped FROM customer""")
def cleaned_values(spark, d):
    """Missing values by strict and closed ranges, signal to noise, guarded log ratio, aperture correction, significant digits, clamp."""
    k, v = F.col("c_custkey"), F.col("c_acctbal")
    return table(spark, d, "customer").select(
        k, s.finite_within(v, 0.0, 9000.0).alias("strict"), s.in_range(v, 0.0, 9000.0).alias("closed"),
        *_six(sn=s.signal_to_noise(v, k % 7 - 1, 1.25), ratio=s.log_ratio(v, k % 5, k % 3 > 0), corrected=s.aperture_corrected(v, (k % 11).cast("double"), 3.0, 1.3)),
        s.significant(v / 7).alias("short"), s.clamp(v, 0.0, 5000.0).alias("clamped"))


@query("""WITH v AS (SELECT o_orderkey AS k, radians(o_orderkey % 360) AS a, radians(o_custkey % 90) AS d FROM orders)
SELECT k, round(cos(d) * cos(a), 6) AS x, round(cos(d) * sin(a), 6) AS y, round(sin(d), 6) AS z, round(2 * asin((k % 20) / 20.0::DOUBLE), 6) AS angle FROM v""")
def sky_vectors(spark, d):
    """Unit vectors of spherical coordinates, and the angle of a chord."""
    k = F.col("o_orderkey")
    x, y, z = s.unit_vector(k % 360, F.col("o_custkey") % 90)
    return table(spark, d, "orders").select(k.alias("k"), *_six(x=x, y=y, z=z, angle=s.chord_to_angle((k % 20) / F.lit(10.0))))


@query("""WITH q AS (SELECT quantile_cont(c_acctbal, 0.01) AS q1, quantile_cont(c_acctbal, 0.02) AS q2, quantile_cont(c_acctbal, 0.98) AS q98, quantile_cont(c_acctbal, 0.99) AS q99 FROM customer),
r AS (SELECT *, (least(9000, q99) - greatest(7000, q1)) / (q99 - q1) > 0.25 AS ok FROM q), b AS (SELECT CASE WHEN ok THEN 9000 ELSE q2 END AS lo, CASE WHEN ok THEN 7000 ELSE q98 END AS hi FROM r)
SELECT c_custkey, round(least(greatest((c_acctbal - lo) / (hi - lo), 0.0::DOUBLE), 1.0::DOUBLE), 6) AS c FROM customer, b""")
def colored_rows(spark, d):
    """The place of a value on the colour scale; the range asked for is taken only if it covers enough of the data."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    q = [r["q"] for r in encode.quantile_table(c, ["c_acctbal"]).orderBy("k").collect()]  # 101 numbers
    return c.select("c_custkey", *_six(c=project.color_value(F.col("c_acctbal"), *project.color_range(q, (9000.0, 7000.0)))))


# ---- text ------------------------------------------------------------------------------------------------------------

_PAIRS = "'total=' || (o_totalprice)::DECIMAL(18, 2) || ' cust: ' || o_custkey || ' total=7 name=x'"


@query(f"""WITH t AS (SELECT o_orderkey, {_PAIRS} AS t FROM orders)
SELECT o_orderkey, regexp_extract(t, 'total=([-+]?\\d+(?:\\.\\d+)?)', 1)::DOUBLE AS total, regexp_extract(t, 'cust: (\\d+)', 1)::DOUBLE AS cust, 2 AS n FROM t""")
def key_numbers(spark, d):
    """key = number pairs of a text as a map; of a repeated key the first counts."""
    t = F.concat(F.lit("total="), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" cust: "), F.col("o_custkey").cast("string"), F.lit(" total=7 name=x"))
    return table(spark, d, "orders").select("o_orderkey", tx.key_numbers(t).alias("m")).select("o_orderkey", F.col("m")["total"].alias("total"), F.col("m")["cust"].alias("cust"), F.size("m").alias("n"))


@query("SELECT p_partkey, p_type || ' ' || p_brand || ' ' || p_type AS text FROM part")
def text_from_index(spark, d):
    """Texts put together again from their inverted index (word -> places)."""
    w = F.split(F.concat_ws(" ", "p_type", "p_brand", "p_type"), " ")
    places = lambda v: F.filter(F.transform(F.col("w"), lambda x, i: F.when(x == v, i)), lambda i: i.isNotNull())
    index = F.map_from_entries(F.transform(F.array_distinct("w"), lambda v: F.struct(v, places(v))))
    return table(spark, d, "part").select("p_partkey", w.alias("w")).select("p_partkey", tx.text_of_index(index).alias("text"))


@query(r"""WITH s AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '(^|[^\\])%[^\n]*', '\1', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS t, text FROM documents)
SELECT doc_id, contains(t, trim(regexp_replace(substr(replace(text, '%', ''), 11, 30), '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS found FROM s""")
def excerpt_found(spark, d):
    """Whether a text, without comments and with white space collapsed, holds an excerpt."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.holds(t, F.substring(F.replace(t, F.lit("%"), F.lit("")), 11, 30)).alias("found"))


@query("""WITH v AS (SELECT c_custkey AS k, c_acctbal AS x, (c_custkey % 1000) / 1000.0::DOUBLE * 100 AS p FROM customer)
SELECT k, regexp_replace(format('{:,.1f}', x), '^-', '−') AS fixed, CASE WHEN p >= 10 THEN format('{:,.0f}', p) WHEN p >= 1 THEN format('{:,.1f}', p) ELSE format('{:,.2f}', p) END AS share,
  k || CASE WHEN k % 100 BETWEEN 11 AND 13 THEN 'th' WHEN k % 10 = 1 THEN 'st' WHEN k % 10 = 2 THEN 'nd' WHEN k % 10 = 3 THEN 'rd' ELSE 'th' END AS place FROM v""")
def number_labels(spark, d):
    """Numbers as labels: typographic minus, percent by size, ordinals."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("k"), tx.with_minus(F.col("c_acctbal"), 1).alias("fixed"), tx.percent((k % 1000) / F.lit(1000.0)).alias("share"), tx.ordinal(k).alias("place"))


# ---- joins, fits, clusters -------------------------------------------------------------------------------------------

_LINE = ("l_orderkey", "l_partkey", "l_suppkey")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, min(l_linenumber) AS first_line, arg_max(l_quantity, l_linenumber)::DOUBLE AS last_quantity FROM lineitem GROUP BY ALL""")
def one_to_one(spark, d):
    """A join on three keys that are unique on either side, each side reduced to a row per key first."""
    keys = list(_LINE)
    li = dealt(table(spark, d, "lineitem").select(*keys, "l_linenumber", "l_quantity"), keys)  # both sides and their join keep this dealing
    first = ingest.keep_best(li, keys, [F.col("l_linenumber")]).select(*keys, F.col("l_linenumber").alias("first_line"))
    last = ingest.keep_best(li, keys, [F.col("l_linenumber").desc()]).select(*keys, F.col("l_quantity").cast("double").alias("last_quantity"))
    return ingest.left_one_to_one(first, last, keys)


def _clipped(x: str, y: str, clip: float = 5.0, rounds: int = 4) -> str:
    """The rounds of a robust line as common table expressions: f<i> the fit, m<i> and s<i> middle and spread of the residuals."""
    out, rows = "", "facts"
    for i in range(rounds):
        out += f""",
f{i} AS (SELECT regr_slope({y}, {x}) AS b, regr_intercept({y}, {x}) AS a FROM {rows}), r{i} AS (SELECT facts.*, {y} - (a + b * {x}) AS r FROM facts, f{i}),
m{i} AS (SELECT median(r) AS m FROM r{i}), s{i} AS (SELECT 1.4826 * median(abs(r - m)) AS s FROM r{i}, m{i}), d{i} AS (SELECT r{i}.* FROM r{i}, s{i} WHERE abs(r) < {clip} * s)"""
        rows = f"d{i}"
    return out


@query(WITH.rstrip() + _clipped("nl", "ext") + " SELECT round(a, 5) AS a, round(b, 5) AS b, round(s, 5) AS sigma FROM f3, s3")
def robust_line(spark, d):
    """Least squares with four rounds of clipping about the residuals' spread."""
    (a, b), sigma = stats.robust_fit(facts(spark, d), [F.lit(1.0), F.col("nl")], F.col("ext"))
    return spark.createDataFrame([(round(float(a), 5), round(float(b), 5), round(float(sigma), 5))], "a double, b double, sigma double")


@query(WITH.rstrip() + _clipped("price", "acct") + " SELECT k, acct IS NULL AS filled, round(coalesce(acct, a + b * price), 3) AS acct FROM facts, f3 WHERE price IS NOT NULL AND nl IS NOT NULL AND disc IS NOT NULL")
def imputed_values(spark, d):
    """Complete rows with a missing value replaced by a robust fit."""
    f, terms = facts(spark, d), [F.lit(1.0), F.col("price")]
    beta, _ = stats.robust_fit(f, terms, F.col("acct"))
    full = f.dropna(subset=["price", "nl", "disc"]).withColumn("filled", F.col("acct").isNull())
    return stats.imputed(full, "acct", terms, beta).select("k", "filled", F.round("acct", 3).alias("acct"))


_MASS, _RATE = "8 + (o_custkey % 400) / 100.0::DOUBLE", "(o_orderkey % 300) / 100.0::DOUBLE - 2"


@query(f"""WITH t AS (SELECT {_MASS} AS m, {_RATE} - ({_MASS}) AS r FROM orders), q AS (SELECT r + 11 AS e FROM t WHERE m BETWEEN {relations.RELATIONS['Q11s'].low} AND {relations.RELATIONS['Q11s'].high})
SELECT 'Q11s' AS id, count(e) AS n, round(CASE WHEN count(e) < 50 THEN 0 ELSE median(e) END, 6) AS mid FROM q""")
def relation_residuals(spark, d):
    """How far rows lie from a published relation inside its range."""
    k = F.col("o_orderkey")
    t = table(spark, d, "orders").select((8 + (F.col("o_custkey") % 400) / F.lit(100.0)).alias("logM"), ((k % 300) / F.lit(100.0) - 2).alias("rate")).withColumn("logsSFR", F.col("rate") - F.col("logM"))
    return relations.median_residuals(t, ["Q11s"]).select("id", "n", F.round("mid", 6).alias("mid"))


def _halved(name: str, source: str, low: str, high: str, excess: str, out: str, steps: int = 50) -> str:
    """SQL of the root ``out`` of a rising ``excess`` of u for each row of source, by a recursive table of brackets."""
    return (f"{name}_r AS (SELECT *, {low} AS lo, {high} AS hi, 0 AS i FROM {source} UNION ALL SELECT * EXCLUDE (lo, hi, i, u, e), CASE WHEN e > 0 THEN lo ELSE u END, CASE WHEN e > 0 THEN u ELSE hi END, i + 1"
            f" FROM (SELECT *, {excess} AS e FROM (SELECT *, (lo + hi) / 2 AS u FROM {name}_r WHERE i < {steps}))), {name} AS (SELECT * EXCLUDE (lo, hi, i), (lo + hi) / 2 AS {out} FROM {name}_r WHERE i = {steps})")


def _enclosed(x: str) -> str:
    return f"(ln(1 + {x}) - ({x}) / (1 + {x}))"


def _concentration(halo, m: str) -> str:
    norm, slope, evolution = conversions.CONCENTRATION[halo.kind]
    return f"({norm * (1 + halo.z) ** evolution!r}::DOUBLE * pow(10.0::DOUBLE, {slope!r}::DOUBLE * ({m} + {math.log10(halo.h / conversions.PIVOT)!r}::DOUBLE)))"


def _from_mean(halo, shift: float) -> str:
    c = _concentration(halo, "u")
    x = f"({c} * pow(10.0::DOUBLE, (m - {shift!r}::DOUBLE - u - {math.log10(halo.thinner())!r}::DOUBLE) / 3))"
    return f"u + log10({_enclosed(x)} / {_enclosed(c)}) - (m - {shift!r}::DOUBLE)"


_HALO = conversions.Halo("vir", 0.7, 0.27)
_C = _concentration(_HALO, "m")


@query(f"""WITH RECURSIVE v AS (SELECT o_orderkey AS k, 11 + (o_custkey % 400) / 100.0::DOUBLE AS m FROM orders), p AS (SELECT DISTINCT m, {_C} AS c FROM v),
{_halved("w", "p", "log10(c) - 3", "log10(c) + 3", f"{_enclosed('c')} * {_HALO.thinner()!r}::DOUBLE / pow(c, 3) - {_enclosed('pow(10.0::DOUBLE, u)')} / pow(10.0::DOUBLE, 3 * u)", "x")}
SELECT k, round(m, 6) AS m, round(m + log10({_enclosed("pow(10.0::DOUBLE, x)")} / {_enclosed("c")}), 6) AS wide, round(m, 6) AS back FROM v JOIN w USING (m)""")
def halo_masses(spark, d):
    """Masses of one definition on the scale of another, and back: an equation solved in every row."""
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (11 + (F.col("o_custkey") % 400) / F.lit(100.0)).alias("m"))
    t = t.withColumn("wide", _HALO.to_mean(F.col("m")))
    return t.select("k", *_six(m=F.col("m"), wide=F.col("wide"), back=_HALO.from_mean(F.col("wide"))))


_CONVERTED = ("Mo13", "B13", "H12", "C18", "S03L", "S03E", "K03S")


def _size_sql(early: bool) -> tuple[str, str, str]:
    """The r-band radius, what is solved for its magnitude u, and the radius within the aperture at the magnitude mag."""
    far, near = conversions.APERTURE_FIT, conversions.PROFILE_FIT
    z = f"{math.log10(2.88e-6)!r}::DOUBLE + 0.56::DOUBLE * m" if early else "-1 + 0.14::DOUBLE * m + 0.25::DOUBLE * log10(1 + pow(10.0::DOUBLE, m) / 3.98e10)"
    at = (lambda f, u: f"({f.b!r}::DOUBLE - 0.4::DOUBLE * {f.a!r}::DOUBLE * ({u}))") if early else (
        lambda f, u: f"({f.gamma!r}::DOUBLE - 0.4::DOUBLE * {f.alpha!r}::DOUBLE * ({u}) + {f.beta - f.alpha!r}::DOUBLE * log10(1 + pow(10.0::DOUBLE, -0.4::DOUBLE * ({u} - {f.turn!r}::DOUBLE))))")
    share = conversions.EARLY_SHARE if early else relations.LATE_SHARE
    return f"{z} + {relations.RED['early' if early else 'late']!r}::DOUBLE", f"r - {at(near, 'u')}", at(far, f"mag - {2.5 * math.log10(share)!r}::DOUBLE")


_NUMBERS = relations.halo_fraction(0.1)
_A1 = 1 / 1.1
_NU = math.exp(-4 * _A1 * _A1)
_B13 = dict(turn=11.514 + (-1.793 * (_A1 - 1) - 0.251 * 0.1) * _NU, eps=-1.777 - 0.006 * (_A1 - 1) * _NU - 0.119 * (_A1 - 1), alpha=-1.412 + 0.731 * (_A1 - 1) * _NU,
            delta=3.508 + (2.608 * (_A1 - 1) - 0.043 * 0.1) * _NU, gamma=0.316 + (1.319 * (_A1 - 1) + 0.279 * 0.1) * _NU)
_BEND = lambda u: f"(-log10(pow(10.0::DOUBLE, {_B13['alpha']!r}::DOUBLE * ({u})) + 1) + {_B13['delta']!r}::DOUBLE * pow(log10(1 + exp({u})), {_B13['gamma']!r}::DOUBLE) / (1 + exp(pow(10.0::DOUBLE, -({u})))))"
_LATE, _EARLY = _size_sql(False), _size_sql(True)
_GAS = ", ".join(f"({a[0]}, {b[0]}, {a[1]}, {b[1]})" for a, b in zip(relations.GAS_MEDIANS, relations.GAS_MEDIANS[1:], strict=False))
_IN = lambda i: f"m BETWEEN {relations.RELATIONS[i].low!r}::DOUBLE AND {relations.RELATIONS[i].high!r}::DOUBLE"


@query(f"""WITH RECURSIVE t AS (SELECT 10 + (o_orderkey % 400) / 80.0::DOUBLE AS halo, 7 + (o_orderkey % 400) / 80.0::DOUBLE AS mass, (o_custkey % 300) / 100.0::DOUBLE AS y FROM orders),
h AS (SELECT DISTINCT halo AS m FROM t), g AS (SELECT DISTINCT mass AS m FROM t),
{_halved("mo", "h", f"m - {relations.PER_H!r}::DOUBLE - 1", f"m - {relations.PER_H!r}::DOUBLE + 1", _from_mean(relations.MO13, relations.PER_H), "s")},
{_halved("be", "h", "m - 1", "m + 1", _from_mean(relations.B13, 0.0), "s")},
late AS (SELECT m, {_LATE[0]} AS r FROM g), early AS (SELECT m, {_EARLY[0]} AS r FROM g),
{_halved("l", "late", "-27.0::DOUBLE", "-12.0::DOUBLE", _LATE[1], "mag")}, {_halved("e", "early", "-27.0::DOUBLE", "-12.0::DOUBLE", _EARLY[1], "mag")},
seg(x0, x1, y0, y1) AS (VALUES {_GAS}),
c AS (SELECT 'Mo13' AS id, m, s + log10({2 * _NUMBERS[0]!r}::DOUBLE / (pow(10.0::DOUBLE, {-_NUMBERS[2]!r}::DOUBLE * (s - {_NUMBERS[1]!r}::DOUBLE)) + pow(10.0::DOUBLE, {_NUMBERS[3]!r}::DOUBLE * (s - {_NUMBERS[1]!r}::DOUBLE)))) + {relations.HEAVIER + 2 * relations.PER_H!r}::DOUBLE AS f FROM mo WHERE {_IN("Mo13")}
  UNION ALL SELECT 'B13', m, {_B13['eps'] + _B13['turn'] + relations.HEAVIER!r}::DOUBLE + {_BEND(f"s - {_B13['turn']!r}::DOUBLE")} - {_BEND("0.0::DOUBLE")} FROM be WHERE {_IN("B13")}
  UNION ALL SELECT 'H12', m, CASE WHEN m - {relations.HEAVIER!r}::DOUBLE < 9 THEN 0.712::DOUBLE * (m - {relations.HEAVIER!r}::DOUBLE) + 3.117 ELSE 0.276::DOUBLE * (m - {relations.HEAVIER!r}::DOUBLE) + 7.042 END - m FROM g WHERE {_IN("H12")}
  UNION ALL SELECT 'C18', m, any_value(y0 + (y1 - y0) * ((m - x0) / (x1 - x0)::DOUBLE)) FROM g JOIN seg ON m BETWEEN x0 AND x1 GROUP BY m
  UNION ALL SELECT 'S03L', m, {_LATE[2]} FROM l WHERE {_IN("S03L")} UNION ALL SELECT 'S03E', m, {_EARLY[2]} FROM e WHERE {_IN("S03E")}),
q AS (SELECT id, y + CASE id WHEN 'Mo13' THEN 8 WHEN 'B13' THEN 8 WHEN 'S03L' THEN 0 WHEN 'S03E' THEN 0 ELSE -2 END - f AS r FROM t JOIN c ON c.m = CASE WHEN id IN ('Mo13', 'B13') THEN halo ELSE mass END
  UNION ALL SELECT 'K03S', mass - {relations.DENSE!r}::DOUBLE FROM t)
SELECT id, count(r) AS n, round(CASE WHEN count(r) < 50 THEN 0 ELSE median(r) END, 5) AS mid FROM (VALUES {", ".join(f"('{i}')" for i in _CONVERTED)}) AS every(id) LEFT JOIN q USING (id) GROUP BY id""")
def converted_residuals(spark, d):
    """How far rows lie from the relations that need another mass scale, another radius or a table of medians."""
    k, c = F.col("o_custkey") % 300 / F.lit(100.0), F.col("o_orderkey") % 400 / F.lit(80.0)
    halo = table(spark, d, "orders").select((c + 10).alias("logMh"), (k + 8).alias("logM"))
    mass = table(spark, d, "orders").select((c + 7).alias("logM"), (c + 7).alias("logSigma"), (k - 2).alias("logfHI"), k.alias("logR50"))
    both = relations.median_residuals(halo, ["Mo13", "B13"]).union(relations.median_residuals(mass, list(_CONVERTED[2:])))
    return both.select("id", "n", F.round("mid", 5).alias("mid"))


def _share_sql(r: str) -> str:
    """Share of the light within r: the series of the incomplete gamma function with its terms written out by their logarithms."""
    return f"coalesce(list_sum(list_transform(range(160), lambda j: exp((2 * n + j) * ln(b * pow({r}, 1 / n)) - b * pow({r}, 1 / n) - lgamma(2 * n + j + 1)))), 0)"


_WHOLE = f"CASE WHEN b * pow({{0}}, 1 / n) > 2 * n + 20 + 8 * sqrt(2 * n) THEN 1 ELSE {_share_sql('{0}')} END"
_AT = lambda r: "(" + _WHOLE.replace("{0}", r) + ")"
_HALF = "coalesce(list_sum(list_transform(range(160), lambda j: exp((2 * n + j) * ln(u) - u - lgamma(2 * n + j + 1)))), 0) - 0.5"


@query(f"""WITH RECURSIVE p AS (SELECT DISTINCT (p_size % 8 + 1) / 2.0::DOUBLE AS n FROM part), {_halved("hb", "p", "0.001::DOUBLE", "2 * n + 1", _HALF, "b")},
{_halved("hr", "hb", "log10(0.05::DOUBLE)", "log10(50.0::DOUBLE)", f"0.2::DOUBLE * (1.25::DOUBLE * 1.25 - 0.8::DOUBLE * 0.8) * {_AT('pow(10.0::DOUBLE, u)')} - ({_AT('(1.25::DOUBLE * pow(10.0::DOUBLE, u))')} - {_AT('(0.8::DOUBLE * pow(10.0::DOUBLE, u))')})", "lr", 40)},
hs AS (SELECT n, b, pow(10.0::DOUBLE, lr) AS ring, {_AT('(2 * pow(10.0::DOUBLE, lr))')} AS share FROM hr), {_halved("hh", "hs", "0.0001::DOUBLE", "2 * ring", f"{_AT('u')} - share / 2", "half")}
SELECT n, round(b, 6) AS b, round(ring, 6) AS ring, round(share, 6) AS share, round(half, 6) AS half, parts FROM hh JOIN (SELECT (p_size % 8 + 1) / 2.0::DOUBLE AS n, count(*) AS parts FROM part GROUP BY 1) USING (n)""")
def profile_constants(spark, d):
    """Half-light, ring and aperture constants of the profile indices in a table, solved once per different index."""
    t = table(spark, d, "part").select(((F.col("p_size") % 8 + 1) / F.lit(2.0)).alias("index")).groupBy("index").agg(F.count("*").alias("parts"))
    got = conversions.profile_constants(t, "index")
    return got.join(t, got["n"] == t["index"]).select("n", *_six(**{c: F.col(c) for c in ("b", "ring", "share", "half")}), "parts")


@query()
def minibatch_clusters(spark, d):
    """Representatives of a thousand clusters of lines, found by mini-batches: the centres, and the row nearest to each."""
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("q"), (F.avg("l_extendedprice") / 1500).alias("e"), (F.avg("l_discount") * 500).alias("x"))
    t = settled(t.select("l_orderkey", F.array("q", "e", "x").alias("v")), "lines")
    centers = cluster.minibatch_kmeans(t, "v", 1000, "l_orderkey", passes=4)
    near = cluster.assign(t, "v", centers, "l_orderkey")
    first = near.groupBy("cluster").agg(F.min(F.struct("dist", "l_orderkey")).alias("f"), F.count("*").alias("n"))
    return first.select("cluster", F.col("f.l_orderkey").alias("l_orderkey"), F.round("f.dist", 6).alias("dist"), "n")


_BASIS = ", ".join(f"round(pow(t, {j}) * pow(c, {i}), 6) AS b{j}{i}" for j, n in enumerate(stats.COLOR_POWERS) for i in range(n))


@query(f"""WITH v AS (SELECT l_orderkey * 8 + l_linenumber AS k, least(greatest(l_quantity / 12 - 1, -0.5::DOUBLE), 2.5::DOUBLE) AS c, CASE WHEN l_linenumber < 7 THEN least(greatest(l_discount * 5, 0.0::DOUBLE), 0.3::DOUBLE) - 0.1::DOUBLE END AS t FROM lineitem)
SELECT k, {_BASIS} FROM v""")
def color_basis(spark, d):
    """The terms of a fit in a color and a redshift, both clipped."""
    c, z = F.col("l_quantity") / 12 - 1, F.when(F.col("l_linenumber") < 7, F.col("l_discount") * 5)
    names = [f"b{j}{i}" for j, n in enumerate(stats.COLOR_POWERS) for i in range(n)]
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("k"), *_six(**dict(zip(names, stats.color_basis(c, z), strict=True))))


_STAR = ((0, 10), (6, -8), (-10, 3), (10, 3), (-6, -8))  # crosses itself: its middle is outside by the even-odd rule


@query(f"""WITH v AS (SELECT p_partkey AS polygon, (p_partkey * 37) % 10000 AS cx, (p_partkey * 53) % 5000 AS cy, 5 + p_size % 15 AS s FROM part),
g AS (SELECT polygon, {", ".join(f"(cx + {x} * s) / 100.0::DOUBLE AS x{i}, (cy + {y} * s) / 100.0::DOUBLE AS y{i}" for i, (x, y) in enumerate(_STAR))} FROM v),
p AS (SELECT l_extendedprice / 1000 AS x, round(l_extendedprice * 100)::BIGINT AS cents, l_quantity + (l_orderkey % 100) / 100.0::DOUBLE AS y FROM lineitem),
m AS (SELECT *, {" + ".join(f"CASE WHEN (y{i} > y) <> (y{j} > y) AND x < (x{j} - x{i}) * (y - y{i}) / nullif(y{j} - y{i}, 0) + x{i} THEN 1 ELSE 0 END" for i, j in ((k, (k + 1) % 5) for k in range(5)))} AS crossings
  FROM p JOIN g ON y >= least(y1, y4) AND y <= y0 AND x >= x2 AND x <= x3)
SELECT polygon, count(*) AS n, sum(cents)::BIGINT AS cents FROM m WHERE crossings % 2 = 1 GROUP BY polygon""")
def polygon_counts(spark, d):
    """Rows in each of many polygons, one for each part."""
    k, size = F.col("p_partkey"), 5 + F.col("p_size") % 15
    star = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, (x, y) in enumerate(_STAR)])
    v = table(spark, d, "part").select(k.alias("polygon"), (k * 37 % 10000).alias("cx"), (k * 53 % 5000).alias("cy"), size.alias("s"), F.explode(star).alias("v"))
    v = v.select("polygon", "v.i", ((F.col("cx") + F.col("v.x") * F.col("s")) / F.lit(100.0)).alias("x"), ((F.col("cy") + F.col("v.y") * F.col("s")) / F.lit(100.0)).alias("y"))
    p = table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("x"), s.whole(F.col("l_extendedprice") * 100).alias("cents"), (F.col("l_quantity") + F.col("l_orderkey") % 100 / F.lit(100.0)).alias("y"))
    return polygons.counted_in_polygons(p, F.col("x"), F.col("y"), v, {"cents": F.col("cents")})


def _clusters(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") % 97).cast("int").alias("cluster"), F.col("o_totalprice").cast("double").alias("dist"), (F.col("o_orderstatus") == "O").alias("local"))
    return cluster.ranked_in_cluster(o, "row_id")


_CLUSTERS = "c AS (SELECT o_orderkey AS row_id, (o_custkey % 97)::INTEGER AS cluster, (o_totalprice)::DOUBLE AS dist, o_orderstatus = 'O' AS local FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY dist, row_id)::INTEGER AS rank FROM c)"


@query(f"""WITH {_CLUSTERS}, h AS (SELECT *, min(dist) OVER (PARTITION BY cluster) AS d0 FROM r WHERE rank <= 5)
SELECT cluster, row_id, rank, dist FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY CASE WHEN local AND dist <= 1.5 * d0 THEN 0 ELSE 1 END, rank) AS o FROM h) WHERE o = 1""")
def first_fit(spark, d):
    """One row per cluster: a local one among the nearest if it is near enough, else the nearest."""
    return cluster.first_fit(_clusters(spark, d), F.col("local")).select("cluster", "row_id", "rank", "dist")


@query(f"WITH {_CLUSTERS} SELECT cluster, arg_min(row_id, rank) AS row_id, min(rank) AS rank FROM r WHERE row_id % 3 <> 0 GROUP BY cluster HAVING min(rank) <= 25")
def tested_representatives(spark, d):
    """The best member of each cluster that passes a test, one candidate per cluster and round."""
    return cluster.representatives(_clusters(spark, d), "row_id", lambda c: c.where("row_id % 3 <> 0")).select("cluster", "row_id", "rank")


@query(f"""WITH {_CLUSTERS}, n AS (SELECT cluster, count(*) AS n FROM r GROUP BY cluster)
SELECT count(*) AS clusters, min(n) AS least, quantile_cont(n, 0.05) AS p5, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.95) AS p95, max(n) AS most FROM n""")
def cluster_sizes(spark, d):
    return cluster.size_percentiles(_clusters(spark, d))


@query(f"""WITH {_CLUSTERS}, p AS (SELECT row_id, row_number() OVER (ORDER BY cluster, row_id) - 1 AS place FROM r WHERE rank = 1) SELECT row_id, coalesce(place, -1) AS place FROM r LEFT JOIN p USING (row_id)""")
def rows_to_representatives(spark, d):
    """Every row with its place in the list of representatives, -1 where it is none."""
    c = _clusters(spark, d)
    return cluster.places(c, c.where("rank = 1"), "row_id", ["cluster", "row_id"]).select("row_id", "place")


_WEEK = f"(SELECT day, sum(q) AS q FROM {_DAYS} GROUP BY day)"


@query(f"""WITH p AS (SELECT day, q, row_number() OVER (ORDER BY day) AS i FROM {_WEEK}), ab AS (SELECT a.i AS a, b.i AS b, (SELECT avg(c.q) FROM p c WHERE c.i BETWEEN a.i AND b.i) AS v FROM p a JOIN p b ON a.i <= b.i),
low AS (SELECT p.i, p.day, a, min(v) AS v FROM p JOIN ab ON a <= i AND b >= i GROUP BY ALL), fit AS (SELECT day, round(max(v), 6) AS y FROM low GROUP BY day)
SELECT DISTINCT unnest([min(day), max(day)])::DOUBLE AS x, y FROM fit GROUP BY y""")
def isotonic_knots(spark, d):
    """The knots of the nearest monotonic curve."""
    b = _days(spark, d).groupBy("day").agg(F.sum("q").alias("q")).select(F.col("day").cast("double").alias("day"), F.col("q").cast("double").alias("q"))
    return trends.isotonic(b, "day", "q").select("x", F.round("y", 6).alias("y"))


# ---- files -----------------------------------------------------------------------------------------------------------

@query(f"""WITH {SQL}, o AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || k), k) - 1 AS rank FROM facts)
SELECT rank, round(CASE WHEN price BETWEEN {RANGES['price'][0]} AND {RANGES['price'][1]} THEN {RANGES['price'][0]} + round_even((price - {RANGES['price'][0]}) / {RANGES['price'][1] - RANGES['price'][0]} * 65534, 0) * ({RANGES['price'][1] - RANGES['price'][0]} / 65534) END, 9) AS value FROM o""")
def column_files(spark, d):
    """A dimension written as blocks of byte-shuffled, gzipped codes in the seeded order, and read back."""
    to = scratch(spark, "column-files")
    rows = encode.permuted(facts(spark, d), "k", SEED, "rank")
    columns.write_columns(rows, "rank", {"price": RANGES["price"]}, to, 4096).write.format("noop").mode("overwrite").save()
    return columns.read_column(spark, to, "price", *RANGES["price"], 4096).select("rank", F.round("value", 9).alias("value"))


@query("SELECT c_custkey::VARCHAR AS id, c_acctbal AS balance, least(c_custkey % 4, 3) = 0 AS first_chunk FROM customer")
def compiled_chunks(spark, d):
    """Gzipped CSV chunks with string ids, some rows in two chunks, compiled to a row per id."""
    to, c = scratch(spark, "chunks"), table(spark, d, "customer")
    one = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_acctbal").alias("balance"), (F.col("c_custkey") % 4).alias("part"))
    both = one.unionByName(one.where("part = 0").withColumn("part", F.lit(2).cast(one.schema["part"].dataType)))  # these come twice
    both.write.partitionBy("part").option("header", True).option("compression", "gzip").csv(to)
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("balance", T.DoubleType())])
    found = [readers.compiled_chunks(spark, f"{to}/part={k}", schema, ["id"]).select("id", "balance", F.lit(k).alias("k")) for k in range(4)]
    every = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    return ingest.keep_best(every, ["id"], [F.col("k")]).select("id", "balance", (F.col("k") == 0).alias("first_chunk"))


@query("SELECT s_suppkey AS id, s_acctbal AS balance, s_name AS note FROM supplier WHERE s_suppkey % 5 <> 0")
def irregular_lines(spark, d):
    """Lines of typed fields with a free tail, among comments and lines that don't parse."""
    to = scratch(spark, "irregular")
    line = F.when(F.col("s_suppkey") % 5 == 0, F.concat_ws(" ", F.lit("x"), "s_acctbal", "s_name")).otherwise(F.concat_ws("   ", "s_suppkey", "s_acctbal", "s_name"))
    table(spark, d, "supplier").select(F.explode(F.array(line, F.lit("# comment"), F.lit(" "))).alias("value")).write.text(to)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("balance", T.DoubleType())])
    return readers.irregular_text(spark, to, schema)[0]


@query("SELECT 'nation-' || s_nationkey AS chunk, s_suppkey, s_name, s_acctbal FROM supplier")
def acquired_chunks(spark, d):
    """A file of rows per nation, fetched chunk by chunk in two runs, of which the first is given half of the plan; compiled."""
    to, folder = scratch(spark, "served"), scratch(spark, "fetched")
    wanted = ["s_suppkey", "s_name", "s_acctbal"]
    table(spark, d, "supplier").select("s_nationkey", *wanted).repartition("s_nationkey").write.partitionBy("s_nationkey").option("header", True).csv(to)
    files = readers.listing(spark, f"{to}/*/*.csv").select(F.regexp_extract("path", r"s_nationkey=(\d+)", 1).alias("n"), "path").collect()  # a row for each nation
    plan = sorted((f"nation-{r['n']}.csv.gz", r["path"].replace("file:/", "file:///", 1) if not r["path"].startswith("file://") else r["path"]) for r in files)
    for some in (plan[::2], plan):
        acquire.acquire(spark, some, folder, wanted, in_flight=8)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in wanted])
    got = readers.compiled_chunks(spark, f"{folder}/*.csv.gz", schema, ["s_suppkey"])
    return got.select("chunk", F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))


_BACK = lambda k: f"round(CASE WHEN {k} BETWEEN {RANGES[k][0]} AND {RANGES[k][1]} THEN {RANGES[k][0]!r} + round_even(({k} - {RANGES[k][0]!r}) / ({RANGES[k][1]!r}::DOUBLE - {RANGES[k][0]!r}) * 65534, 0) * (({RANGES[k][1]!r}::DOUBLE - {RANGES[k][0]!r}) / 65534) END, 6)"


@query(WITH + f"SELECT k::DOUBLE AS k, {_BACK('price')} AS price, {_BACK('acct')} AS acct, st, (SELECT count_if(st = 0) FROM facts)::INTEGER AS unclassed FROM facts")
def export_round_trip(spark, d):
    """Facts in a seeded order, exported, a dependent block added, exported again with the block carried over, and read back column by column."""
    to = scratch(spark, "export")
    rows = settled(encode.permuted(facts(spark, d).select("k", "price", "acct", "st"), "k", SEED, "rank"), "ordered")
    kinds = {"dims": {k: RANGES[k] for k in ("price", "acct")}, "cats": {"st": ["filled", "open", "part"]}, "meta": {"k": {"dtype": "u32", "offset": -5}}}
    first = export.write_export(rows, "rank", "k", to, **kinds, block=4096)
    export.set_block(to, "counted", {"unclassed": first["columns"]["st"]["missing"]}, first["order"])
    m = export.write_export(rows, "rank", "k", to, **kinds, block=4096)
    if export.verified(spark, to).where("not ok").count():
        raise ValueError("the export's files aren't those of its manifest")
    # the files are packed, so their size doesn't tell how large a column is: a join by size would send it to the driver and all tasks
    one = lambda name: export.read_export(spark, to, name).withColumnRenamed("value", name).hint("merge")
    back = one("k").join(one("price"), "rank").join(one("acct"), "rank").join(one("st"), "rank")
    return back.select("k", F.round("price", 6).alias("price"), F.round("acct", 6).alias("acct"), "st", F.lit(m["blocks"]["counted"]["unclassed"]).alias("unclassed"))


# ---- events ----------------------------------------------------------------------------------------------------------

ORACLE_SQL["hysteresis_steps"] = """WITH RECURSIVE e AS (SELECT user_id, event_id, (value)::DOUBLE AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, event_id, value, i, value AS base, true AS hit FROM e WHERE i = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.value, e.i, CASE WHEN e.value > w.base * 1.35 OR e.value < w.base / 1.35 THEN e.value ELSE w.base END, e.value > w.base * 1.35 OR e.value < w.base / 1.35
  FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id, event_id, value FROM w WHERE hit"""
