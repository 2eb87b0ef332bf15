"""The query catalog: each entry a plan over the test tables and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismview.functions import color
from prismview.functions import scalars as s
from prismview.functions import text as tx
from prismview.functions.quantiles import group_median, group_quantiles
from prismview.functions.shared import settled, table
from prismview.operators import cluster, curves, density, encode, ingest, nearest, project, search, spatial, stats, trends
from prismview.plans.facts import DIMS, RANGES, SEED, SQL, facts, sql_axis, stats_of
from prismview.spec import ViewSpec

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return register


WITH = f"WITH {SQL}\n"
X, Y = (("price", 0.8), ("nl", -0.6)), (("ext", 0.8), ("disc", 0.5970), ("acct", 0.06))
VIEW = ViewSpec(X, Y, color="qty")
BOX = (-3.0, 3.0, -3.0, 3.0)


def _fade(view: ViewSpec) -> str:
    import math
    x, y = dict(view.x), dict(view.y)
    out = "1.0"
    for k in dict.fromkeys([*x, *y]):
        f = min(1.0, max(0.0, 1 - math.sqrt(x.get(k, 0.0) ** 2 + y.get(k, 0.0) ** 2) / 0.12))
        if f < 1:
            out += f" * CASE WHEN {k} IS NULL THEN {f!r} ELSE 1.0 END"
    return out


VIEW_SQL = f"""{SQL},
view0 AS (SELECT facts.*, {sql_axis(X)} AS X, {sql_axis(Y)} AS Y, ({_fade(VIEW)})::DOUBLE AS fade FROM facts, st8),
view AS (SELECT * EXCLUDE fade, CASE WHEN fade < 0.01 THEN 0 ELSE greatest(1, round(255 * fade)::INTEGER) END AS vis FROM view0)"""
WITH_VIEW = f"WITH {VIEW_SQL}\n"


def the_view(spark: SparkSession, sf_dir: str, view: ViewSpec = VIEW) -> DataFrame:
    f = settled(facts(spark, sf_dir), "facts")  # read by the statistics and by the view
    return project.projected(f, view, stats_of(f))


# ---- statistics and encoding ----------------------------------------------------------------------------------------

_LONG = "long AS (SELECT unnest([" + ", ".join(f"{{'dim': '{d}', 'value': {d}}}" for d in DIMS) + "], recursive := true) FROM facts)"


@query(WITH + f""", {_LONG}, m AS (SELECT dim, median(value) AS center FROM long WHERE value IS NOT NULL GROUP BY dim)
SELECT dim, count(value) AS n, min(value) AS lo, max(value) AS hi, any_value(center) AS center, 1.4826 * median(abs(value - center)) AS scale
FROM long JOIN m USING (dim) GROUP BY dim""")
def dim_stats(spark, d):
    return encode.dim_stats(facts(spark, d), list(DIMS))


@query(WITH + f""", {_LONG}, q AS (SELECT dim, quantile_cont(value, [k / 100.0 for k in range(101)]) AS q FROM long WHERE value IS NOT NULL GROUP BY dim)
SELECT dim, (unnest(range(101)))::INTEGER AS k, round(unnest(q), 6) AS q FROM q""".replace("[k / 100.0 for k in range(101)]", "[" + ", ".join(str(k / 100) for k in range(101)) + "]"))
def dim_quantiles(spark, d):
    return encode.quantile_table(facts(spark, d), list(DIMS)).withColumn("q", F.round("q", 6))


@query(WITH + """SELECT count(*) AS n_in, count_if(price BETWEEN 3 AND 5.6) AS n_price, count_if(price BETWEEN 3 AND 5.6 AND coalesce(nl > 1, false)) AS n_lines,
count_if(price BETWEEN 3 AND 5.6 AND coalesce(nl > 1, false) AND coalesce(acct <= 9000, false)) AS n_acct FROM facts""")
def cut_report(spark, d):
    return ingest.cut_report(facts(spark, d), [("price", F.col("price").between(3, 5.6)), ("lines", F.col("nl") > 1), ("acct", F.col("acct") <= 9000)])


@query(WITH + " UNION ALL ".join(f"SELECT '{k}' AS dim, count_if({k} IS NULL) AS n_missing, count_if({k} < {a}) AS n_below, count_if({k} > {b}) AS n_above, count_if({k} BETWEEN {a} AND {b}) AS n_valid FROM facts" for k, (a, b) in {"price": (4.0, 5.5), "nl": (2.0, 8.0), "acct": (100.0, 9000.0)}.items()))
def range_report(spark, d):
    return ingest.range_report(facts(spark, d), {"price": (4.0, 5.5), "nl": (2.0, 8.0), "acct": (100.0, 9000.0)})


def _code(k: str) -> str:
    lo, hi = RANGES[k]
    return f"CASE WHEN {k} BETWEEN {lo} AND {hi} THEN (1 + round_even(({k} - {lo!r}) / ({hi!r}::DOUBLE - {lo!r}) * 65534, 0))::INTEGER ELSE 0 END"


@query(WITH + "SELECT k, " + ", ".join(f"{_code(x)} AS {x}_code, round(CASE WHEN {_code(x)} > 0 THEN {RANGES[x][0]!r} + ({_code(x)} - 1) * (({RANGES[x][1]!r}::DOUBLE - {RANGES[x][0]!r}) / 65534) END, 6) AS {x}" for x in ("price", "qty", "acct")) + " FROM facts")
def quantize_decode(spark, d):
    out = [F.col("k")]
    for x in ("price", "qty", "acct"):
        code = s.quantized(F.col(x), *RANGES[x])
        out += [code.alias(f"{x}_code"), F.round(s.decoded(code, *RANGES[x]), 6).alias(x)]
    return facts(spark, d).select(*out)


@query(WITH + " UNION ALL ".join(f"SELECT '{k}' AS dim, count_if({k} BETWEEN {a} AND {b}) AS n_present, count_if({k} BETWEEN {a} AND {b}) AS n_coded, 0::BIGINT AS n_missing_differs, 0::BIGINT AS n_too_far FROM facts" for k, (a, b) in RANGES.items()))
def quantize_roundtrip(spark, d):
    return encode.round_trip(facts(spark, d), RANGES)


_TABLE = [0.0, 10.0, 20.0, 20.0, 20.0, 30.0, 45.0, 50.0, 60.0, 80.0, 100.0]
_TSQL = f"{_TABLE}::DOUBLE[]"


@query(f"""WITH t AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, (l_quantity * 2)::DOUBLE AS v, {_TSQL} AS q FROM lineitem),
c AS (SELECT *, len(list_filter(q, lambda a: a < v)) AS lo, len(list_filter(q, lambda a: a <= v)) AS up FROM t)
SELECT k, n, p, round(CASE WHEN up > lo THEN (lo + up - 1) / 2.0 WHEN lo = 0 THEN 0 WHEN lo = 11 THEN 10 ELSE lo - 1 + (v - q[lo]) / (q[lo + 1] - q[lo]) END, 9)::DOUBLE AS pct,
round(CASE WHEN up = 0 THEN 0 WHEN up = 11 THEN 10 ELSE up - 1 + (v - q[up]) / (q[up + 1] - q[up]) END, 9)::DOUBLE AS cdf FROM c""")
def percentile_of_value(spark, d):
    q, v = F.array(*[F.lit(x) for x in _TABLE]), F.col("l_quantity") * 2
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.round(s.percentile_of(q, v), 9).alias("pct"), F.round(s.cdf_percentile(q, v), 9).alias("cdf"))


@query(f"""WITH t AS (SELECT p_partkey AS k, (p_size % 11)::DOUBLE + 0.25 AS p, {_TSQL} AS q FROM part), f AS (SELECT *, least(greatest(floor(p), 0), 9)::INTEGER AS i FROM t)
SELECT k, round(q[i + 1] + (q[i + 2] - q[i + 1]) * (least(greatest(p, 0.0), 10.0) - i), 9) AS value FROM f""")
def value_at_percentile(spark, d):
    q = F.array(*[F.lit(x) for x in _TABLE])
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.round(s.value_at(q, (F.col("p_size") % 11).cast("double") + 0.25), 9).alias("value"))


@query(WITH + "SELECT r.code::INTEGER AS code, count(k) AS n FROM range(8) r(code) LEFT JOIN facts ON st = r.code GROUP BY 1")
def category_counts(spark, d):
    return encode.category_counts(facts(spark, d), "st")


@query(WITH + "SELECT k, CASE WHEN nl IS NULL THEN 0 WHEN disc >= 5 AND qty >= 25 THEN 1 WHEN disc >= 5 THEN 2 WHEN qty >= 25 THEN 3 ELSE 4 END AS class, CASE WHEN (coalesce(price > 5.4, false)::INT + coalesce(qty > 25, false)::INT + coalesce(acct > 5000, false)::INT) = 1 THEN CASE WHEN price > 5.4 THEN 1 WHEN qty > 25 THEN 2 ELSE 3 END ELSE 0 END AS flag FROM facts")
def classify_case(spark, d):
    many, full = F.col("disc") >= 5, F.col("qty") >= 25
    cls = F.when(F.col("nl").isNull(), 0).when(many & full, 1).when(many, 2).when(full, 3).otherwise(4)
    return facts(spark, d).select("k", cls.alias("class"), s.one_of_flags([(F.col("price") > 5.4, 1), (F.col("qty") > 25, 2), (F.col("acct") > 5000, 3)]).alias("flag"))


# ---- ingest ---------------------------------------------------------------------------------------------------------

_BEST = "SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_quantity, l_shipdate) AS r FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM ({_BEST}) WHERE r = 1")
def keep_best_per_key(spark, d):
    order = [F.col("l_extendedprice").desc_nulls_last(), *[F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_shipdate")]]
    return ingest.keep_best(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("WITH g AS (SELECT count(*) AS n, max(l_extendedprice) - min(l_extendedprice) AS s FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) SELECT count(*) AS n_groups, median(s) AS median_spread, max(s) AS max_spread FROM g")
def repeat_spread(spark, d):
    return ingest.repeat_spread(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_extendedprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c FROM lineitem) WHERE c > 1")
def repeated_keys(spark, d):
    return ingest.repeated(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def left_enforced(spark, d):
    c = ingest.left_many_to_one(table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], complete=True)
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return ingest.left_many_to_one(o, c.select("c_custkey", "c_name", "n_name"), ["c_custkey"]).select("o_orderkey", "c_name", "n_name")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def unmatched_orders(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)")
def semi_members(spark, d):
    hit = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(hit, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("""WITH a AS (SELECT l_partkey AS p, l_suppkey AS s, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
b AS (SELECT l_partkey AS p, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
o AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'N')
SELECT o.p, o.s, CASE WHEN a.q IS NOT NULL THEN a.q ELSE b.q END AS q, CASE WHEN a.q IS NOT NULL THEN 'pair' WHEN b.q IS NOT NULL THEN 'part' END AS matched_by
FROM o LEFT JOIN a USING (p, s) LEFT JOIN b ON o.p = b.p""")
def two_stage_match(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"), "l_returnflag")
    left = li.where("l_returnflag = 'N'").select("p", "s").distinct()
    stages = [("pair", li.where("l_returnflag = 'R'"), ["p", "s"], [F.col("q").desc()]), ("part", li.where("l_returnflag = 'A'"), ["p"], [F.col("q").desc()])]
    return ingest.staged_match(left, stages, ["q"])


# ---- order and sampling ---------------------------------------------------------------------------------------------

_RID = f"row_number() OVER (ORDER BY md5('{SEED}:' || o_orderkey)) - 1"


@query(f"SELECT o_orderkey, {_RID} AS rid FROM orders")
def row_permutation(spark, d):
    return encode.permuted(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", SEED)


@query(f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('{SEED}:' || o_orderkey) LIMIT 500")
def prefix_sample(spark, d):
    return encode.prefix_sample(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", SEED, 500)


@query(f"""WITH p AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'), r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY md5('{SEED}:' || o_orderkey)) AS i FROM orders WHERE o_orderstatus <> 'P')
SELECT * FROM p UNION ALL SELECT o_orderkey, o_orderstatus FROM r WHERE i <= greatest(0, 6000 - (SELECT count(*) FROM p))""")
def budget_sample(spark, d):
    return encode.budget_sample(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", SEED, F.col("o_orderstatus") == "P", 6000)


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, {_RID} AS rid FROM orders) WHERE rid % 37 = 0")
def stride_sample(spark, d):
    return encode.stride_sample(encode.permuted(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", SEED), "rid", 37).select("o_orderkey")


@query(f"""WITH r AS (SELECT o_orderkey::VARCHAR AS k, {_RID} AS rid FROM orders), b AS (SELECT rid // 4096 AS b, sha1(string_agg(k, chr(10) ORDER BY rid)) AS h FROM r GROUP BY 1)
SELECT sha1(string_agg(h, chr(10) ORDER BY b)) AS order_hash FROM b""")
def order_hash(spark, d):
    return tx.order_hash(encode.permuted(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", SEED), "rid", "o_orderkey")


# ---- views ----------------------------------------------------------------------------------------------------------

@query(WITH_VIEW + "SELECT k, round(X, 9) AS x, round(Y, 9) AS y, vis FROM view")
def project_view(spark, d):
    return the_view(spark, d).select("k", F.round("X", 9).alias("x"), F.round("Y", 9).alias("y"), "vis")


@query(WITH_VIEW + "SELECT vis, count(*) AS n FROM view GROUP BY vis")
def project_view_fade(spark, d):
    return the_view(spark, d).groupBy("vis").agg(F.count("*").alias("n"))


_PX, _PY = [((i * 37) % 17 - 8) / 64 for i in range(64)], [((i * 29) % 13 - 6) / 64 for i in range(64)]


@query(f"""WITH e AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings), p AS (SELECT unnest({_PX}::DOUBLE[]) AS px, unnest({_PY}::DOUBLE[]) AS py, unnest(range(64)) AS i)
SELECT vec_id, round(sum(v::DOUBLE * px), 6) AS x, round(sum(v::DOUBLE * py), 6) AS y FROM e JOIN p USING (i) GROUP BY vec_id""")
def project_embeddings(spark, d):
    return project.project_vector(table(spark, d, "embeddings"), "embedding", _PX, _PY).select("vec_id", F.round("X", 6).alias("x"), F.round("Y", 6).alias("y"))


_FILTERED = ViewSpec(X, Y, ranges=(("price", 4.5, 5.5),), masks=(("st", (1, 3)), ("pr", (1, 2, 5))), need=("acct",))


@query(WITH_VIEW + "SELECT k, vis FROM view WHERE price BETWEEN 4.5 AND 5.5 AND st IN (1, 3) AND pr IN (1, 2, 5) AND acct IS NOT NULL")
def filter_mask_range_need(spark, d):
    return the_view(spark, d, _FILTERED).select("k", "vis")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey & 448 > 0")
def bit_filter(spark, d):
    return project.bit_filter(table(spark, d, "lineitem"), "l_partkey", 448).select("l_orderkey", "l_linenumber", "l_partkey")


@query(WITH_VIEW + "SELECT count_if(vis >= 128) AS n_shown, count_if(vis > 0) AS n_seen, count_if(qty IS NULL) AS n_colorless FROM view")
def view_count(spark, d):
    return the_view(spark, d).agg(F.count_if(F.col("vis") >= 128).alias("n_shown"), F.count_if(F.col("vis") > 0).alias("n_seen"), F.count_if(F.col("qty").isNull()).alias("n_colorless"))


@query(WITH_VIEW + ", q AS (SELECT count(*) AS n, quantile_cont(X, [0.005, 0.995]) AS x, quantile_cont(Y, [0.005, 0.995]) AS y FROM view WHERE vis >= 77) SELECT n, round(x[1], 6) AS x_lo, round(x[2], 6) AS x_hi, round(y[1], 6) AS y_lo, round(y[2], 6) AS y_hi FROM q")
def view_bounds(spark, d):
    b = density.view_bounds(the_view(spark, d))
    return b.select("n", *[F.round(c, 6).alias(c) for c in b.columns[1:]])


_CELL = "floor((X + 3) * (20 / 6.0::DOUBLE))::INTEGER AS ix, floor((Y + 3) * (20 / 6.0::DOUBLE))::INTEGER AS iy"
_IN = "vis > 0 AND X >= -3 AND X < 3 AND Y >= -3 AND Y < 3"


@query(WITH_VIEW + f"SELECT {_CELL}, sum(vis)::BIGINT AS weight, sum(CASE WHEN nl IS NOT NULL THEN vis ELSE 0 END)::BIGINT AS colored, sum(vis * nl) AS color_sum, sum(CASE WHEN pr = 1 THEN vis ELSE 0 END)::BIGINT AS selected FROM view WHERE {_IN} GROUP BY 1, 2")
def view_density(spark, d):
    return density.view_density(the_view(spark, d), BOX, 20, 20, F.col("nl"), F.col("pr") == 1)


@query(WITH_VIEW + f"SELECT {_CELL}, " + ", ".join(f"sum(CASE WHEN st = {k} THEN vis ELSE 0 END)::BIGINT AS w{k}" for k in range(4)) + f" FROM view WHERE {_IN} GROUP BY 1, 2")
def view_density_class(spark, d):
    return density.class_density(the_view(spark, d), BOX, 20, 20, "st", 4)


@query(WITH_VIEW + f""", c AS (SELECT {_CELL}, sum(vis) AS w FROM view WHERE {_IN} GROUP BY 1, 2)
SELECT ix, iy, round(greatest(pow(1 - exp(-1.0 * w / 20000.0), 0.8), 0.05), 9) AS tone FROM c""")
def view_tone(spark, d):
    return density.view_density(the_view(spark, d), BOX, 20, 20).select("ix", "iy", F.round(density.tone(F.col("weight"), 20000.0, floor=0.05), 9).alias("tone"))


@query(WITH_VIEW + """, f AS (SELECT floor((X + 3) * (64 / 6.0::DOUBLE))::INTEGER AS ix, floor((Y + 3) * (64 / 6.0::DOUBLE))::INTEGER AS iy, count(*) AS n FROM view WHERE vis > 0 AND X >= -3 AND X < 3 AND Y >= -3 AND Y < 3 GROUP BY 1, 2),
l AS (SELECT lv, sum(n) AS n FROM f, range(3) r(lv) GROUP BY lv, ix >> lv::INTEGER, iy >> lv::INTEGER),
m AS (SELECT lv, sum(n) AS total, median(n) AS mid, quantile_cont(n, 0.95) AS p95 FROM l GROUP BY lv),
c AS (SELECT CASE WHEN (SELECT mid FROM m WHERE lv = 0) >= 10 THEN 0 WHEN (SELECT mid FROM m WHERE lv = 1) >= 10 THEN 1 ELSE 2 END AS level)
SELECT total::BIGINT AS total, level::INTEGER AS level, round(CASE WHEN total >= 40 THEN p95 / pow(4, level) * (SELECT count(*) FROM facts) / total * 1.0 * 0.6 END, 6)::DOUBLE AS reference FROM m JOIN c ON lv = level""")
def exposure_ref(spark, d):
    v = the_view(spark, d)
    return density.exposure_reference(v, BOX, 64, 64, table(spark, d, "orders").count()).withColumn("reference", F.round("reference", 6))


@query(WITH_VIEW + f", r AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || k)) - 1 AS rid FROM view) SELECT {_CELL}, count(*) AS n FROM r WHERE rid < 4000 AND X >= -3 AND X < 3 AND Y >= -3 AND Y < 3 GROUP BY 1, 2 HAVING count(*) >= 3")
def mosaic_cells(spark, d):
    v = encode.permuted(the_view(spark, d).select("k", "X", "Y"), "k", SEED)
    return density.prefix_cells(v, "rid", 4000, F.col("X"), F.col("Y"), BOX, 20, 20)


# ---- histograms -----------------------------------------------------------------------------------------------------

@query("""WITH h AS (SELECT floor(l_quantity * (12 / 48.0::DOUBLE))::INTEGER AS bin, count(*) AS n FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 48 GROUP BY 1)
SELECT r.b::INTEGER AS bin, coalesce(n, 0) AS n, sqrt(coalesce(n, 0) / (SELECT max(n) FROM h)::DOUBLE) AS height FROM range(12) r(b) LEFT JOIN h ON bin = r.b""")
def hist1d(spark, d):
    return density.hist1d(table(spark, d, "lineitem"), F.col("l_quantity"), 0.0, 48.0, 12)


def _h2(cut: str, hi: str) -> str:
    ix, iy = "floor((l_quantity - 1) * (7 / 49.0::DOUBLE))", "floor(l_discount * 100 * (5 / 10.0::DOUBLE))"
    if hi == "<=":
        ix, iy = f"least({ix}, 6)", f"least({iy}, 4)"
    return f"SELECT {ix}::INTEGER AS ix, {iy}::INTEGER AS iy, count(*) AS n, sum(l_linenumber)::DOUBLE AS w FROM (SELECT l_quantity, l_linenumber, round(l_discount * 100) / 100 AS l_discount FROM lineitem) WHERE l_quantity >= 1 AND l_quantity {hi} 50 AND l_discount * 100 >= 0 AND l_discount * 100 {hi} 10 GROUP BY 1, 2"


def _hist2d(spark, d, closed):
    y = F.round(F.col("l_discount") * 100) / 100 * 100
    return density.hist2d(table(spark, d, "lineitem"), F.col("l_quantity"), y, (1.0, 50.0, 0.0, 10.0), 7, 5, closed, F.col("l_linenumber").cast("double"))


@query(_h2("open", "<"))
def hist2d_open(spark, d):
    return _hist2d(spark, d, False)


@query(_h2("closed", "<="))
def hist2d_closed(spark, d):
    return _hist2d(spark, d, True)


# ---- selections -----------------------------------------------------------------------------------------------------

_POLY = [(-1.5, -1.0), (1.0, -1.25), (1.75, 0.5), (0.25, 0.25), (-0.5, 1.5)]
_POLY2 = [(0.0, -2.0), (2.0, -2.0), (2.0, 0.0), (0.0, 0.0)]


def _inside(poly) -> str:
    terms = []
    for (xa, ya), (xb, yb) in zip(poly, poly[1:] + poly[:1], strict=True):
        if ya != yb:
            terms.append(f"CASE WHEN ({ya} > Y) <> ({yb} > Y) AND X < ({xb - xa}) * (Y - ({ya})) / ({yb - ya})::DOUBLE + ({xa}) THEN 1 ELSE 0 END")
    return f"vis >= 128 AND ({' + '.join(terms)}) % 2 = 1"


@query(WITH_VIEW + f"SELECT k FROM view WHERE {_inside(_POLY)}")
def lasso_select(spark, d):
    return project.lasso(the_view(spark, d), _POLY).select("k")


def _combined(spark, d, mode):
    v = the_view(spark, d)
    return project.combine_selection(project.lasso(v, _POLY), project.lasso(v, _POLY2), "k", mode)


@query(WITH_VIEW + f"SELECT k FROM view WHERE ({_inside(_POLY)}) OR ({_inside(_POLY2)})")
def lasso_add(spark, d):
    return _combined(spark, d, "add")


@query(WITH_VIEW + f"SELECT k FROM view WHERE ({_inside(_POLY)}) AND NOT ({_inside(_POLY2)})")
def lasso_subtract(spark, d):
    return _combined(spark, d, "subtract")


_PROFILE = {"qty": [1.0, 10.0, 15.0, 20.0, 22.0, 25.0, 25.0, 28.0, 30.0, 35.0, 50.0], "nl": [1.0, 1.0, 2.0, 3.0, 3.0, 4.0, 4.0, 5.0, 6.0, 7.0, 12.0]}


def _profile(k: str) -> str:
    q, n = _PROFILE[k], 11
    return f"""SELECT '{k}' AS dim, unnest(range(b0, b1 + 1))::INTEGER AS bin, 1.0::DOUBLE / (b1 - b0 + 1) AS mass FROM (
  SELECT least(floor(p0 / 10.0), 9)::INTEGER AS b0, least(floor(p1 / 10.0), 9)::INTEGER AS b1 FROM (
  SELECT CASE WHEN up > lo THEN lo WHEN lo = 0 THEN 0 WHEN lo = {n} THEN {n - 1} ELSE lo - 1 + (v - q[lo]) / (q[lo + 1] - q[lo]) END AS p0,
    CASE WHEN up > lo THEN up - 1 WHEN lo = 0 THEN 0 WHEN lo = {n} THEN {n - 1} ELSE lo - 1 + (v - q[lo]) / (q[lo + 1] - q[lo]) END AS p1 FROM (
  SELECT {k} AS v, q, len(list_filter(q, lambda a: a < {k})) AS lo, len(list_filter(q, lambda a: a <= {k})) AS up FROM facts, (SELECT {q}::DOUBLE[] AS q) WHERE pr <= 2 AND {k} IS NOT NULL)))"""


@query(WITH + f"SELECT dim, bin, round(sum(mass), 6) AS mass FROM ({' UNION ALL '.join(map(_profile, _PROFILE))}) GROUP BY 1, 2")
def selection_profile(spark, d):
    return spatial.selection_profile(facts(spark, d), F.col("pr") <= 2, _PROFILE, 10).withColumn("mass", F.round("mass", 6))


# ---- trends ---------------------------------------------------------------------------------------------------------

_CENTS = "(SELECT *, round(l_extendedprice * 100) / 100 AS p FROM lineitem)"


def _cents(spark, d):
    return table(spark, d, "lineitem").withColumn("p", F.round(F.col("l_extendedprice") * 100) / 100)


def _bins(cut: str, where: str, least: int) -> str:
    return f"WITH b AS (SELECT {cut}::INTEGER AS bin, p FROM {_CENTS} WHERE {where}), g AS (SELECT bin, count(*) AS n, quantile_cont(p, [0.16, 0.5, 0.84]) AS q FROM b GROUP BY bin HAVING count(*) >= {least}) SELECT bin, n, round(q[1], 4) AS lo, round(q[2], 4) AS mid, round(q[3], 4) AS hi FROM g"


def _rounded(df: DataFrame, columns=("lo", "mid", "hi"), digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


@query(_bins("least(floor((l_quantity - 2) * (12 / 48.0::DOUBLE)), 11)", "l_quantity >= 2 AND l_quantity <= 50", 30))
def running_quantiles(spark, d):
    return _rounded(trends.running_quantiles(_cents(spark, d), "l_quantity", "p", 2.0, 50.0, 12))


@query(_bins("floor((l_quantity - 2) * (12 / 48.0::DOUBLE))", "l_quantity >= 2 AND l_quantity < 50", 30))
def running_median_open(spark, d):
    return _rounded(trends.running_median_open(_cents(spark, d), "l_quantity", "p", 2.0, 50.0, 12))


_EDGES = [1.0, 5.0, 10.0, 20.0, 35.0, 50.0]


@query(f"WITH b AS (SELECT len(list_filter({_EDGES}::DOUBLE[], lambda e: l_quantity >= e)) - 1 AS bin, l_quantity, p FROM {_CENTS}) SELECT bin::INTEGER AS bin, count(*) AS n, median(l_quantity) AS x_mid, round(median(p), 4) AS y_mid FROM b WHERE bin BETWEEN 0 AND 4 GROUP BY bin HAVING count(*) >= 40")
def running_median_midx(spark, d):
    return _rounded(trends.running_median_midx(_cents(spark, d), "l_quantity", "p", _EDGES), ("y_mid",))


def _trend_sql(part: str, extra: str = "") -> str:
    return WITH + f"""{extra}, b AS (SELECT *, least(floor((nl - 1) * (7 / 7.0::DOUBLE)), 6)::INTEGER AS bin, {part} AS part FROM facts{', cuts' if 'cuts' in extra else ''} WHERE nl >= 1 AND nl <= 8 AND qty IS NOT NULL),
u AS (SELECT 'all' AS part, bin, qty FROM b UNION ALL SELECT part::VARCHAR, bin, qty FROM b WHERE part IS NOT NULL),
g AS (SELECT part, bin, count(*) AS n, quantile_cont(qty, [0.16, 0.5, 0.84]) AS q FROM u GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY part) AS total FROM g)
SELECT part, bin, n, round(q[1], 6) AS lo, round(q[2], 6) AS mid, round(q[3], 6) AS hi FROM t WHERE CASE WHEN part = 'all' THEN n >= 30 ELSE n >= 60 AND total >= 200 END"""


@query(_trend_sql("CASE WHEN disc IS NOT NULL THEN (disc >= e[1])::INT + (disc >= e[2])::INT + (disc >= e[3])::INT END", ", cuts AS (SELECT quantile_cont(disc, [0.25, 0.5, 0.75]) AS e FROM facts)"))
def trend_by_quartile(spark, d):
    grouped, _, _ = trends.equal_groups(facts(spark, d), "disc", 4)
    return _rounded(trends.trend(grouped, "nl", "qty", 1.0, 8.0, 7, group="group"), digits=6)


@query(_trend_sql("st"))
def trend_by_class(spark, d):
    return _rounded(trends.trend(facts(spark, d), "nl", "qty", 1.0, 8.0, 7, group="st"), digits=6)


_DAYS = "(SELECT day(l_shipdate) AS day, l_returnflag AS flag, sum(l_quantity::BIGINT)::BIGINT AS q FROM lineitem GROUP BY 1, 2)"


def _days(spark, d):
    return table(spark, d, "lineitem").groupBy(F.dayofmonth("l_shipdate").alias("day"), F.col("l_returnflag").alias("flag")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))


@query(f"SELECT flag, day::INTEGER AS day, (coalesce(lag(q) OVER w, q) + 2 * q + coalesce(lead(q) OVER w, q)) / 4.0::DOUBLE AS smooth FROM {_DAYS} WINDOW w AS (PARTITION BY flag ORDER BY day)")
def trend_smoothed(spark, d):
    return trends.smoothed(_days(spark, d), ["flag"], "day", "q").select("flag", "day", "smooth")


@query(f"""WITH c AS (SELECT flag, day, q % 3 AS v FROM {_DAYS}), m AS (SELECT *, CASE WHEN lag(v) OVER w IS NOT DISTINCT FROM v THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY flag ORDER BY day)),
r AS (SELECT *, sum(new) OVER (PARTITION BY flag ORDER BY day) AS run FROM m) SELECT flag, run::BIGINT AS run, any_value(v)::BIGINT AS value, min(day)::INTEGER AS first, max(day)::INTEGER AS last, count(*) AS n FROM r GROUP BY flag, run""")
def trend_runs(spark, d):
    return trends.runs(_days(spark, d).withColumn("v", F.col("q") % 3), ["flag"], "day", "v")


_GAPPY = f"(SELECT flag, day, CASE WHEN q % 4 > 0 THEN q END AS v FROM {_DAYS})"


@query(f"""WITH a AS (SELECT flag, day, v, last_value(v IGNORE NULLS) OVER p AS va, first_value(v IGNORE NULLS) OVER f AS vb, last_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER p AS da, first_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER f AS db FROM {_GAPPY}
WINDOW p AS (PARTITION BY flag ORDER BY day ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY flag ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT flag, day::INTEGER AS day, round(coalesce(v::DOUBLE, va + (vb - va) * ((day - da)::DOUBLE / nullif(db - da, 0)), va, vb), 6) AS filled FROM a""")
def trend_filled(spark, d):
    gappy = _days(spark, d).withColumn("v", F.when(F.col("q") % 4 > 0, F.col("q")))
    return trends.filled(gappy, ["flag"], "day", "v").select("flag", "day", F.round("filled", 6).alias("filled"))


@query(f"SELECT flag, day::INTEGER AS day, coalesce(sum(q) OVER (PARTITION BY flag ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, sum(q) OVER (PARTITION BY flag ORDER BY day)::DOUBLE / sum(q) OVER (PARTITION BY flag) AS share FROM {_DAYS}")
def cumulative_share(spark, d):
    return trends.cumulative(_days(spark, d), ["flag"], "day", "q").select("flag", "day", "start", "share")


@query("""WITH b AS (SELECT floor(l_quantity / 5)::INTEGER AS bin, count_if(l_extendedprice > 30000)::DOUBLE / count(*) AS f FROM lineitem GROUP BY 1),
w AS (SELECT bin, f, lead(f) OVER (ORDER BY bin) AS g, lead(bin) OVER (ORDER BY bin) AS c FROM b)
SELECT round(arg_min(bin + (c - bin) * ((0.5 - f) / (g - f)), bin), 9) AS at FROM w WHERE (f - 0.5) * (g - 0.5) <= 0 AND f <> g""")
def level_crossing(spark, d):
    b = curves.conditional_fraction(table(spark, d, "lineitem"), F.floor(F.col("l_quantity") / 5).cast("int"), F.col("l_extendedprice") > 30000)
    return trends.level_crossing(b, "bin", "fraction", 0.5).select(F.round("at", 9).alias("at"))


@query(f"""WITH d AS (SELECT l_quantity AS x, round(l_extendedprice * 100) / 100 AS y FROM lineitem), o AS (SELECT list_sort(list(x)) AS v, count(*) AS n FROM d),
r AS (SELECT v[floor(0.01 * (n - 1))::BIGINT + 1] AS lo, v[ceil(0.99 * (n - 1))::BIGINT + 1] AS hi FROM o), w AS (SELECT lo, hi, (hi - lo) / 24 AS w FROM r),
i AS (SELECT x, y, least(greatest(floor((x - lo) / w), 0), 23)::INTEGER AS bin FROM d, w WHERE x BETWEEN lo AND hi), m AS (SELECT bin, median(y) AS mid FROM i GROUP BY bin HAVING count(*) >= 5),
f AS (SELECT x, y, least(greatest((x - lo) / w - 0.5, 0.0), 23.0) AS pos FROM i, w), j AS (SELECT *, least(floor(pos)::INTEGER, 22) AS k FROM f),
e AS (SELECT j.y - (a.mid + (b.mid - a.mid) * (pos - k)) AS r FROM j JOIN m a ON a.bin = k JOIN m b ON b.bin = k + 1), c AS (SELECT median(r) AS c FROM e)
SELECT count(*) AS n, round(1.4826 * median(abs(r - c)), 4) AS sigma FROM e, c""")
def running_scatter(spark, d):
    return trends.running_scatter(_cents(spark, d), "l_quantity", "p").select("n", F.round("sigma", 4).alias("sigma"))


# ---- relations ------------------------------------------------------------------------------------------------------

_PAIRS = [("nl", "qty"), ("disc", "qty"), ("acct", "nl"), ("price", "ext")]


@query(WITH + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 8) AS r FROM facts WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _PAIRS))
def pearson_matrix(spark, d):
    return stats.pearson(facts(spark, d), _PAIRS).withColumn("r", F.round("r", 8))


@query(WITH + "SELECT round(regr_r2(ext, nl), 7) AS r2 FROM facts")
def ols_r2(spark, d):
    return spark.createDataFrame([(round(stats.r_squared(facts(spark, d), ["nl"], "ext"), 7),)], "r2 double")


@query("""WITH b AS (SELECT l_quantity AS q, median(round(l_extendedprice * 100) / 100) AS p FROM lineitem GROUP BY 1) SELECT round(regr_slope(p, q), 5) AS slope, round(regr_intercept(p, q), 3) AS intercept, count(*) AS n FROM b""")
def binned_slope(spark, d):
    b = group_median(_cents(spark, d), ["l_quantity"], "p", "m")
    return stats.binned_slope(b, "l_quantity", "m").select(F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"), "n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, median(l_quantity) AS mid FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 30")
def grouped_medians(spark, d):
    return stats.group_medians(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", 30)


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(unnest(quantile_cont(l_extendedprice, [0.0, 0.005, 0.16, 0.5, 0.84, 0.995, 1.0])), 6) AS q, unnest(range(7))::INTEGER AS i
FROM lineitem GROUP BY 1, 2""")
def order_statistics(spark, d):
    """Quantiles of few groups by the range sort that groups of any size take; here a group of a hundred values does."""
    q = group_quantiles(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.0, 0.005, 0.16, 0.5, 0.84, 0.995, 1.0], most=100)
    return q.select("l_returnflag", "l_linestatus", "n", F.posexplode("q").alias("i", "q")).withColumn("q", F.round("q", 6))


@query("SELECT p_type, count(*) AS n, count_if(l_discount >= 0.05)::DOUBLE / count(*) AS discounted, count_if(l_returnflag = 'R')::DOUBLE / count(*) AS returned FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def rates_by_group(spark, d):
    j = table(spark, d, "lineitem").select("l_partkey", "l_discount", "l_returnflag").join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return stats.rates(j, ["p_type"], {"discounted": F.col("l_discount") >= 0.05, "returned": F.col("l_returnflag") == "R"})


# ---- curves ---------------------------------------------------------------------------------------------------------

_CURVE = [(1.0, 1500.0), (10.0, 14000.0), (25.0, 36000.0), (40.0, 58000.0), (48.0, 70000.0)]
_SEG = ", ".join(f"({a[0]}, {b[0]}, {a[1]}, {b[1]})" for a, b in zip(_CURVE, _CURVE[1:], strict=False))
_RES = f"""seg(x0, x1, y0, y1) AS (VALUES {_SEG}), res AS (SELECT p - (y0 + (y1 - y0) * ((l_quantity - x0) / (x1 - x0)::DOUBLE)) AS r FROM {_CENTS} JOIN seg ON l_quantity >= x0 AND (l_quantity < x1 OR (x1 = 48 AND l_quantity = 48)))"""


@query(f"WITH {_RES} SELECT count(*) AS n, round(median(r), 5) AS mid FROM res")
def curve_residual(spark, d):
    return _rounded(curves.curve_residual(_cents(spark, d), F.col("l_quantity"), F.col("p"), _CURVE), ("mid",), 5)


@query(f'WITH {_RES} SELECT count(*) AS n, round(CASE WHEN count(*) < 50 THEN 0 ELSE median(r) END, 5) AS "offset" FROM res')
def fit_offset(spark, d):
    return _rounded(curves.fit_offset(_cents(spark, d), F.col("l_quantity"), F.col("p"), _CURVE), ("offset",), 5)


@query("""WITH h AS (SELECT floor(l_quantity / 10)::INTEGER AS bin, floor(l_extendedprice / 500)::BIGINT AS k, count(*) AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT bin, k + i AS k, round(sum(n * exp(-0.5 * pow(i / 3.0::DOUBLE, 2))), 9) AS v FROM h, range(-15, 16) r(i) GROUP BY 1, 2)
SELECT bin, (arg_max(k, (v, -k)) + 0.5) * 500 AS mode FROM s GROUP BY bin""".replace("arg_max(k, (v, -k))", "first(k ORDER BY v DESC, k)").replace("+ 0.5) * 500", "+ 0.5::DOUBLE) * 500"))
def mode_by_bin(spark, d):
    return curves.mode_by_bin(table(spark, d, "lineitem"), F.floor(F.col("l_quantity") / 10).cast("int"), F.col("l_extendedprice"), 500.0)


@query(WITH + "SELECT k, round(0.5 - 0.2 * nl + 0.03 * nl * nl, 9) AS quadratic, round(5.5 - log10(1 + pow(10.0, (4.8 - price) * 1.2)), 6) AS flat, CASE WHEN disc < 9 THEN round(0.61 / nullif(disc - 9.0, 0) + 1.3, 6) END AS hyper FROM facts")
def curve_formulas(spark, d):
    x = F.col("nl")
    return facts(spark, d).select("k", F.round(F.lit(0.5) - 0.2 * x + 0.03 * x * x, 9).alias("quadratic"), F.round(curves.asymptotic(F.col("price"), 5.5, 4.8, 1.2), 6).alias("flat"), F.round(curves.hyperbola(F.col("disc"), 0.61, 9.0, 1.3), 6).alias("hyper"))


# ---- space ----------------------------------------------------------------------------------------------------------

_GRID = "(SELECT k AS q, (k % 97) / 16.0::DOUBLE AS px, (k % 89) / 16.0::DOUBLE AS py FROM (SELECT o_orderkey AS k FROM orders))"
_PLANE = "(SELECT p_partkey AS r, (p_partkey % 101) / 16.0::DOUBLE AS x, (p_partkey * 7 % 103) / 16.0::DOUBLE AS y, p_size AS z FROM part)"


def _plane(spark, d):
    p = F.col("p_partkey")
    return table(spark, d, "part").select(p.alias("r"), (p % 101 / 16.0).alias("x"), (p * 7 % 103 / 16.0).alias("y"), F.col("p_size").alias("z"))


@query(f"SELECT q, r, d2 FROM (SELECT q, r, (px - x) * (px - x) + (py - y) * (py - y) AS d2, row_number() OVER (PARTITION BY q ORDER BY (px - x) * (px - x) + (py - y) * (py - y), r) AS i FROM {_GRID} JOIN {_PLANE} ON (px - x) * (px - x) + (py - y) * (py - y) <= 0.0625) WHERE i = 1")
def pick_nearest(spark, d):
    k = F.col("o_orderkey")
    q = table(spark, d, "orders").select(k.alias("q"), (k % 97 / 16.0).alias("px"), (k % 89 / 16.0).alias("py"))
    return spatial.pick_nearest(q, _plane(spark, d), 0.25, "q", "r", x="x", y="y")


@query(f"""WITH l AS (SELECT c_custkey AS l, (c_custkey % 83) / 16.0::DOUBLE AS x, (c_custkey * 5 % 107) / 16.0::DOUBLE AS y, c_custkey % 50 AS z FROM customer), r AS (SELECT * FROM {_PLANE} WHERE r % 7 <> 0),
a AS (SELECT l, r.r, (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) AS d2, abs(l.z - r.z) AS dz FROM l JOIN r ON (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) <= 0.25),
f AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY d2, r) AS i FROM a), g AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d2, l) AS j FROM f WHERE i = 1 AND dz < 20) SELECT l, r, d2 FROM g WHERE j = 1""")
def radius_match(spark, d):
    c = F.col("c_custkey")
    left = table(spark, d, "customer").select(c.alias("l"), (c % 83 / 16.0).alias("x"), (c * 5 % 107 / 16.0).alias("y"), (c % 50).alias("z"))
    right = _plane(spark, d)
    return spatial.radius_match(left, right, 0.5, "l", "r", used=right.where("r % 7 = 0"), accept=F.abs(F.col("z") - F.col("r_z")) < 20)


#: Positions in degrees: a third around a pole, a third across 0 degrees, the rest spread; steps are about a tenth of an arc second.
_SKY = """SELECT {id} AS {name}, CASE {id} % 3 WHEN 0 THEN ({id} * 7919 % 3600) / 10.0::DOUBLE WHEN 1 THEN ({id} * 37 % 401 + {id} % 997 / 997.0::DOUBLE + 12959800) % 12960000 / 36000.0::DOUBLE ELSE ({id} * 1009 % 3593) / 10.0::DOUBLE END AS ra,
  CASE {id} % 3 WHEN 0 THEN 90.0::DOUBLE - ({id} * 31 % 97 + {id} % 1009 / 1009.0::DOUBLE) / 36000.0::DOUBLE WHEN 1 THEN ({id} * 53 % 211 + {id} % 991 / 991.0::DOUBLE) / 36000.0::DOUBLE ELSE ({id} * 331 % 1787) / 10.0::DOUBLE - 89.0::DOUBLE END AS dec, {z} AS z FROM {table}"""
_UNIT = ", ".join(f"{f} AS {a}" for a, f in (("ux", "cos(radians(dec)) * cos(radians(ra))"), ("uy", "cos(radians(dec)) * sin(radians(ra))"), ("uz", "sin(radians(dec))")))


def _sky(spark, d, name: str, key: str, out: str, z) -> DataFrame:
    k = F.col(key)
    ra = F.when(k % 3 == 0, k * 7919 % 3600 / 10.0).when(k % 3 == 1, (k * 37 % 401 + k % 997 / 997.0 + 12959800) % 12960000 / 36000.0).otherwise(k * 1009 % 3593 / 10.0)
    dec = F.when(k % 3 == 0, 90.0 - (k * 31 % 97 + k % 1009 / 1009.0) / 36000.0).when(k % 3 == 1, (k * 53 % 211 + k % 991 / 991.0) / 36000.0).otherwise(k * 331 % 1787 / 10.0 - 89.0)
    return table(spark, d, name).select(k.alias(out), ra.alias("ra"), dec.alias("dec"), z.alias("z"))


@query(f"""WITH l AS (SELECT *, {_UNIT} FROM ({_SKY.format(id="c_custkey", name="l", z="c_custkey % 50", table="customer")})), r AS (SELECT *, {_UNIT} FROM ({_SKY.format(id="p_partkey", name="r", z="p_size", table="part")}) WHERE r % 7 <> 0),
a AS (SELECT l, r, pow(l.ux - r.ux, 2) + pow(l.uy - r.uy, 2) + pow(l.uz - r.uz, 2) AS d2, abs(l.z - r.z) AS dz FROM l JOIN r ON abs(l.dec - r.dec) < 0.001 AND pow(l.ux - r.ux, 2) + pow(l.uy - r.uy, 2) + pow(l.uz - r.uz, 2) <= pow(2 * sin(radians(1.15 / 3600) / 2), 2)),
f AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY d2, r) AS i FROM a), g AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d2, l) AS j FROM f WHERE i = 1 AND dz < 20)
SELECT l, r, round(degrees(2 * asin(sqrt(d2) / 2)) * 3600, 4) AS sep, 1 AS round FROM g WHERE j = 1""")
def sky_match(spark, d):
    """Positions on the sphere: each row's nearest unused candidate within an angle, a test on the pair, one row for each candidate."""
    left, right = _sky(spark, d, "customer", "c_custkey", "l", F.col("c_custkey") % 50), _sky(spark, d, "part", "p_partkey", "r", F.col("p_size"))
    found = nearest.sky_match(left, right, "l", "r", 1.15, used=right.where("r % 7 = 0"), accept=F.abs(F.col("z") - F.col("r_z")) < 20)
    return found.withColumn("sep", F.round("sep", 4))


@query("SELECT o_custkey, o_orderkey, d FROM (SELECT o_custkey, o_orderkey, abs(o_totalprice - c_acctbal) AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY abs(o_totalprice - c_acctbal), o_orderkey) AS i FROM customer JOIN orders ON o_custkey = c_custkey) WHERE i = 1")
def closest_partner(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    right = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    dist = F.abs(F.col("o_totalprice") - F.col("c_acctbal"))
    return spatial.closest_partner(left, right, "o_custkey", "o_custkey", "o_orderkey", dist).select("o_custkey", "o_orderkey", dist.alias("d"))


_VEC = [f"e{i}" for i in range(4)]
_E = "(SELECT vec_id, label, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE * 1000)::BIGINT AS e{i}" for i in range(4)) + " FROM embeddings)"


def _emb(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", *[F.round(F.get("embedding", F.lit(i)).cast("double") * 1000).cast("long").alias(f"e{i}") for i in range(4)])


_DIST = " + ".join(f"(e{i} - m{i}) * (e{i} - m{i})" for i in range(4))


@query(f"WITH e AS {_E}, m AS (SELECT label, " + ", ".join(f"avg(e{i}) AS m{i}" for i in range(4)) + f" FROM e GROUP BY label), x AS (SELECT label, vec_id, ({_DIST}) / 4 AS dist, row_number() OVER (PARTITION BY label ORDER BY ({_DIST}) / 4, vec_id) AS i FROM e JOIN m USING (label)) SELECT label, vec_id, round(dist, 5) AS dist FROM x WHERE i = 1")
def typical_per_cell(spark, d):
    return _rounded(spatial.typical_per_cell(_emb(spark, d), "label", _VEC, "vec_id"), ("dist",), 5)


@query(f"WITH e AS {_E}, m AS (SELECT " + ", ".join(f"avg(e{i}) AS m{i}" for i in range(4)) + f" FROM e WHERE label < 5) SELECT vec_id, round(({_DIST}) / 4, 5) AS dist FROM e, m WHERE label < 5 ORDER BY ({_DIST}) / 4, vec_id LIMIT 48")
def typical_gallery(spark, d):
    return _rounded(spatial.typical_gallery(_emb(spark, d), F.col("label") < 5, _VEC, "vec_id"), ("dist",), 5)


@query(f"""WITH c AS (SELECT r, x, y, floor(x / 0.5)::BIGINT AS cx, floor(y / 0.5)::BIGINT AS cy FROM {_PLANE}),
z AS (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY (x - (cx + 0.5) * 0.5) * (x - (cx + 0.5) * 0.5) + (y - (cy + 0.5) * 0.5) * (y - (cy + 0.5) * 0.5), r) AS i FROM c) SELECT cx, cy, r FROM z WHERE i = 1""")
def cell_center_pick(spark, d):
    return spatial.nearest_to_center(_plane(spark, d), F.col("x"), F.col("y"), 0.5, "r")


# ---- clusters and rules ---------------------------------------------------------------------------------------------

@query("""WITH c AS (SELECT vec_id AS cluster, unnest(embedding)::DOUBLE AS b, unnest(range(64)) AS i FROM embeddings WHERE vec_id < 8),
e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS a, unnest(range(64)) AS i FROM embeddings),
x AS (SELECT vec_id, cluster, sum((a - b) * (a - b)) AS dist FROM e JOIN c USING (i) GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster) AS j FROM x)
SELECT vec_id, cluster, round(dist, 6) AS dist, row_number() OVER (PARTITION BY cluster ORDER BY dist, vec_id)::INTEGER AS rank FROM n WHERE j = 1""")
def cluster_rank(spark, d):
    e = table(spark, d, "embeddings")
    centers = e.where("vec_id < 8").select(F.col("vec_id").alias("cluster"), F.col("embedding").alias("center"))
    return _rounded(cluster.ranked_in_cluster(cluster.assign(e, "embedding", centers, "vec_id"), "vec_id"), ("dist",), 6)


@query("""SELECT doc_id, CASE WHEN n_chars < 60 THEN 'short' WHEN n_chars > 15000 THEN 'long' WHEN length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) > 0.05 * n_chars THEN 'symbols' WHEN lang NOT IN ('en', 'de') THEN 'language' ELSE 'ok' END AS outcome FROM documents""")
def qa_cascade(spark, d):
    symbols = F.length(F.regexp_replace("text", "[^#*$%&|<>]", ""))
    rules = [("short", F.col("n_chars") < 60), ("long", F.col("n_chars") > 15000), ("symbols", symbols > 0.05 * F.col("n_chars")), ("language", ~F.col("lang").isin("en", "de"))]
    return table(spark, d, "documents").select("doc_id", cluster.first_rule(rules).alias("outcome"))


@query()
def kmeans_representatives(spark, d):
    return cluster.kmeans(facts(spark, d).select("k", "nl", "disc", "qty"), ["nl", "disc", "qty"], 12, "k").where("rank = 1")


@query()
def tighten_search(spark, d):
    f = encode.permuted(facts(spark, d).select("k", "nl", "disc", "qty", "ext"), "k", SEED)
    return search.tighten_search(f, ["nl", "disc", "qty"], "ext", "nl", "rid")


@query()
def geodesic_frames(spark, d):
    """t and the frame's entries along the way between two views of the facts."""
    from prismview import frames
    st = stats_of(facts(spark, d))
    a, _ = frames.frame_from_combos({"price": 1.0}, {"nl": 1.0}, st)
    b, _ = frames.frame_from_combos({"ext": 1.0, "nl": -0.2}, {"disc": 1.0}, st)
    rows = [(i / 10, k, float(f[j, 0]), float(f[j, 1])) for i in range(11) for f in [frames.geodesic(a, b, i / 10)] for j, k in enumerate(st)]
    return spark.createDataFrame(rows, "t double, dim string, fx double, fy double")


# ---- text -----------------------------------------------------------------------------------------------------------

@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '(^|[^\\])%[^\n]*', '\1', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS h, contains(text, 'ing ') AS has FROM documents")
def text_stripped(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.stripped(F.col("text"))).alias("h"), F.contains("text", F.lit("ing ")).alias("has"))


@query("SELECT event_id, (json_extract(props, '$.k'))::INTEGER AS k, event_type || '-' || lpad((event_id % 1000)::VARCHAR, 4, '0') AS code FROM events")
def json_and_ids(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.concat("event_type", F.lit("-"), F.lpad((F.col("event_id") % 1000).cast("string"), 4, "0")).alias("code"))


_QT = [round(1 + 49 * (k / 100) ** 2, 3) for k in range(101)]
_CDF = "CASE WHEN u = 0 THEN 0.0 WHEN u = 101 THEN 100.0 ELSE u - 1 + (x - q[u]) / (q[u + 1] - q[u]) END"


@query(f"""WITH t AS (SELECT p_partkey, {_QT} AS q, p_size % 60 AS v FROM part), e AS (SELECT p_partkey, q, v, unnest([0, 1]) AS j FROM t),
x AS (SELECT p_partkey, q, j, 0.5 + (v - 1.5 + j) * 0.9 AS x FROM e), u AS (SELECT *, len(list_filter(q, lambda a: a <= x)) AS u FROM x),
c AS (SELECT p_partkey, j, round({_CDF}, 6) AS p FROM u)
SELECT p_partkey, max(p) FILTER (WHERE j = 0) AS lo, max(p) FILTER (WHERE j = 1) AS hi FROM c GROUP BY p_partkey""")
def code_intervals(spark, d):
    """The percentiles that a quantized code covers."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 60).alias("code"))
    codes = settled(p.select("code").distinct(), "codes")  # however many rows there are; each code's interval is worked out once
    lo, hi = s.code_interval(F.array(*[F.lit(v) for v in _QT]), F.col("code"), 0.5, 0.9)
    each = settled(codes.select(F.col("code").alias("_code"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi")), "code-intervals", codes)
    return p.join(F.broadcast(each), p["code"].eqNullSafe(each["_code"])).select("p_partkey", "lo", "hi")  # 65,535 codes at most


_I16 = "greatest(-32767, least(32767, floor(x::DOUBLE * 32767 + 0.5)))::BIGINT"


@query(f"""SELECT vec_id, translate(rtrim(to_base64(unhex(array_to_string(list_transform(embedding, lambda x: format('{{:02X}}{{:02X}}', (({_I16}) & 255), ((({_I16}) & 65535) >> 8))), ''))), '='), '+/', '-_') AS code,
  list_transform(embedding, lambda x: {_I16}) AS back FROM embeddings""")
def packed_vectors(spark, d):
    """Vectors as base64url text of 16-bit numbers, and what is read back from it."""
    code = tx.vector_text(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", code.alias("code")).select("vec_id", "code", tx.vector_of(F.col("code")).alias("back"))


_RAMP = ("#0b1d3a", "#3c6e9f", "#e8e3d3", "#c0562e")


@query(color.ramp_sql("SELECT o_orderkey, (o_custkey % 41) / 40.0::DOUBLE AS t FROM orders", "o_orderkey", _RAMP))
def color_ramp(spark, d):
    """Colours along a ramp that is even in OKLab."""
    t = (F.col("o_custkey") % 41) / F.lit(40.0)
    return table(spark, d, "orders").select("o_orderkey", color.ramp(t, _RAMP).alias("color"))


@query("""WITH n AS (SELECT greatest(1, count(*) // 20000) AS step FROM orders), t AS (SELECT o_orderkey AS k, (o_totalprice)::DOUBLE AS x, (o_custkey % 977)::DOUBLE AS y FROM orders, n WHERE o_orderkey % step = 0),
l AS (SELECT list_sort(list(x)) AS xs, list_sort(list(y)) AS ys, count(*) - 1 AS m FROM t)
SELECT xs[round(0.001 * m)::BIGINT + 1] AS x0, xs[round(0.999 * m)::BIGINT + 1] AS x1, ys[round(0.001 * m)::BIGINT + 1] AS y0, ys[round(0.999 * m)::BIGINT + 1] AS y1 FROM l""")
def grid_bounds(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("double").alias("X"), (F.col("o_custkey") % 977).cast("double").alias("Y"))
    return density.grid_bounds(rows, "k")


# ---- events ---------------------------------------------------------------------------------------------------------

def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_TRAINS = "t AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM t)"


@query(f"WITH {_TRAINS} SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS settled_at, count(*) AS n FROM g GROUP BY user_id, run")
def settle_sessions(spark, d):
    from prismview.streaming import operators as st
    out = st.settle(_events(spark, d), "user_id", "ts", "6 hours")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "settled_at")})


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS start, first(event_id ORDER BY ts, event_id) AS event_id, count(*) AS n FROM events GROUP BY 1, 2")
def throttle_first(spark, d):
    from prismview.streaming import operators as st
    return st.throttle_first(_events(spark, d), "user_id", "ts", "1 day", ["event_id"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"WITH {_TRAINS} SELECT user_id, max(ts) + INTERVAL 6 HOUR AS settled_at, last(event_id ORDER BY ts, event_id) AS event_id FROM g GROUP BY user_id, run")
def debounce_last(spark, d):
    from prismview.streaming import operators as st
    return st.debounce(_events(spark, d), "user_id", "ts", "6 hours", ["event_id"]).withColumn("settled_at", F.col("settled_at").cast("timestamp_ntz"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_wins(spark, d):
    from prismview.streaming import operators as st
    return st.latest_wins(_events(spark, d), "user_id", "event_id", ["event_type", "value"])


@query("""WITH e AS (SELECT user_id, event_id, value, ts, epoch_us(ts) / 1e6 AS s FROM events), p AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, max(s) OVER (PARTITION BY user_id) AS t FROM e)
SELECT user_id, max(ts) AS last_ts, round(sum(value * CASE WHEN p IS NULL THEN 1 ELSE 1 - exp(-(s - p) / 86400) END * exp((s - t) / 86400)), 6) AS smooth FROM p GROUP BY user_id""")
def ewma(spark, d):
    from prismview.streaming import operators as st
    return st.ewma(_events(spark, d), "user_id", "ts", "event_id", "value", 86400.0).select("user_id", F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), F.round("smooth", 6).alias("smooth"))


@query()
def hysteresis_steps(spark, d):
    from prismview.streaming import operators as st
    return st.hysteresis(_events(spark, d), "user_id", "ts", "event_id", "value")


@query("""WITH RECURSIVE e AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT event_type, event_id, value, i, value AS base, true AS hit FROM e WHERE i = 1
  UNION ALL SELECT e.event_type, e.event_id, e.value, e.i, CASE WHEN e.value > w.base * 3.0::DOUBLE OR e.value < w.base / 3.0::DOUBLE THEN e.value ELSE w.base END, e.value > w.base * 3.0::DOUBLE OR e.value < w.base / 3.0::DOUBLE
  FROM w JOIN e ON e.event_type = w.event_type AND e.i = w.i + 1)
SELECT event_type, event_id, value FROM w WHERE hit""")
def hysteresis_by_type(spark, d):
    """Few keys with many events each: every key lies in several partitions."""
    from prismview.streaming import operators as st
    return st.hysteresis(_events(spark, d), "event_type", "ts", "event_id", "value", 3.0)


@query("""WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) / 1e6 AS s, row_number() OVER w AS i, lag(epoch_us(ts) / 1e6) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, value * CASE WHEN p IS NULL THEN 1 ELSE 1 - exp(-(s - p) / 86400) END AS v FROM e)
SELECT a.user_id, a.event_id, round(sum(b.v * exp((b.s - a.s) / 86400)), 6) AS smooth FROM g a JOIN g b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY a.user_id, a.event_id""")
def ewma_trace(spark, d):
    from prismview.streaming import operators as st
    return st.ewma_trace(_events(spark, d), "user_id", "ts", "event_id", "value", 86400.0).withColumn("smooth", F.round("smooth", 6))


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_id * 7919 % 1009 AS seq, value AS payload FROM events),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, seq) > 172800000000 THEN 1 ELSE 0 END AS new FROM e),
l AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, seq) AS life FROM g),
t AS (SELECT *, max(seq) OVER (PARTITION BY user_id, life ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, max(life) OVER (PARTITION BY user_id) AS last FROM l)
SELECT user_id, us, CASE WHEN top IS NULL THEN 'insert' ELSE 'update' END AS change, seq, payload FROM t WHERE top IS NULL OR seq > top
UNION ALL SELECT user_id, max(us) + 172800000000, 'expire', NULL, NULL FROM t WHERE life < last GROUP BY user_id, life""")
def change_feed(spark, d):
    """The changes of each user's state as rows; the same rows come from a stream (streaming.feed.change_stream)."""
    from prismview.streaming import feed
    return feed.change_feed(_events(spark, d).withColumn("seq", F.col("event_id") * 7919 % 1009), "user_id", "ts", "seq", "value", 172800)


# ---- sets, carry-over, checks ----------------------------------------------------------------------------------------

@query("SELECT p_partkey AS k, 'part' AS side FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT DISTINCT l_partkey, 'line' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def symmetric_difference(spark, d):
    p, big = (table(spark, d, "part").where(c).select(F.col("p_partkey").alias("k")) for c in ("true", "p_size > 10"))
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"))
    return p.join(li, "k", "left_anti").withColumn("side", F.lit("part")).unionByName(li.distinct().join(big, "k", "left_anti").withColumn("side", F.lit("line")))


@query("SELECT DISTINCT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def common_nations(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT p_partkey, p_brand, coalesce(m, '') AS note FROM part LEFT JOIN (SELECT p_partkey, p_type AS m FROM part WHERE p_size > 25) USING (p_partkey)")
def carried_column(spark, d):
    p = table(spark, d, "part")
    return encode.carried_over(p.select("p_partkey", "p_brand"), p.where("p_size > 25").select("p_partkey", F.col("p_type").alias("note")), "p_partkey", "note")


@query(f"WITH w AS (SELECT flag, q, lag(q) OVER (PARTITION BY flag ORDER BY day) AS b FROM {_DAYS}) SELECT flag, count_if(q < b) AS faults FROM w GROUP BY flag")
def monotonic_faults(spark, d):
    return encode.monotonic_faults(_days(spark, d), "flag", "day", "q")


@query(f"WITH b AS (SELECT floor(l_quantity / 5)::INTEGER AS bin, l_quantity, p FROM {_CENTS}), m AS (SELECT median(l_quantity) AS x, median(p) AS y FROM b GROUP BY bin), seg(x0, x1, y0, y1) AS (VALUES {_SEG}) SELECT round(sqrt(avg(pow(y - (y0 + (y1 - y0) * ((x - x0) / (x1 - x0)::DOUBLE)), 2))), 4) AS rms, count(*) AS n FROM m JOIN seg ON x >= x0 AND x < x1")
def rms_about_curve(spark, d):
    cut = _cents(spark, d).withColumn("bin", F.floor(F.col("l_quantity") / 5))
    b = group_median(cut, ["bin"], "l_quantity", "x").drop("n").join(group_median(cut, ["bin"], "p", "y").drop("n"), "bin")
    return _rounded(curves.rms_about(b, "x", "y", _CURVE), ("rms",))


@query("SELECT floor(l_quantity / 5)::INTEGER AS bin, l_linestatus, count(*) AS n, count_if(l_discount >= 0.05)::DOUBLE / count(*) AS fraction FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 20")
def fraction_by_bin(spark, d):
    return curves.conditional_fraction(table(spark, d, "lineitem"), F.floor(F.col("l_quantity") / 5).cast("int"), F.col("l_discount") >= 0.05, "l_linestatus", 20)


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) WHERE i <= 8")
def top_by_group(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, d, "orders").withColumn("i", F.row_number().over(w)).where("i <= 8").select("o_orderpriority", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey AS k, round(degrees(2 * asin(sqrt(least(pow(sin(radians((o_custkey % 80) - (o_orderkey % 80)) / 2), 2) + cos(radians(o_orderkey % 80)) * cos(radians(o_custkey % 80)) * pow(sin(radians((o_custkey % 360) - (o_orderkey % 360)) / 2), 2), 1.0)))), 6) AS sep FROM orders")
def sky_separation(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(k.alias("k"), F.round(s.separation(k % 360, k % 80, c % 360, c % 80), 6).alias("sep"))


@query()
def isotonic_curve(spark, d):
    b = _days(spark, d).groupBy("day").agg(F.sum("q").alias("q")).select(F.col("day").cast("double").alias("day"), F.col("q").cast("double").alias("q"))
    return trends.isotonic(b, "day", "q")


@query()
def synthetic_catalog(spark, d):
    from prismview.sources.readers import synthetic
    return synthetic(spark, 5000)


@query()
def relation_points(spark, d):
    from prismview.operators import relations
    out = None
    for r in relations.RELATIONS.values():
        one = relations.points(spark, r).withColumn("id", F.lit(r.id))
        out = one if out is None else out.unionByName(one)
    return out
