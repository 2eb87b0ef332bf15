"""The wide table that the view queries run on: one row per order, with dimensions that are really missing in places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismview.functions.scalars import whole
from prismview.functions.shared import table
from prismview.operators.encode import dim_stats

DIMS = ("price", "nl", "ext", "disc", "qty", "acct")
RANGES = {"price": (2.5, 6.0), "nl": (1.0, 12.0), "ext": (2.5, 6.5), "disc": (0.0, 10.0), "qty": (1.0, 50.0), "acct": (0.0, 10000.0)}
SEED = 20260924


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, cust, price, nl, ext, disc, qty, acct, st, pr. The lines are combined per order before they are joined."""
    lines = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
             .agg(F.count("*").alias("nl"), F.sum(whole(F.col("l_extendedprice") * 100)).alias("e"), F.sum(whole(F.col("l_discount") * 100)).alias("d"), F.sum(F.col("l_quantity").cast("long")).alias("q")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    d = orders.join(lines.hint("shuffle_hash"), F.col("o_orderkey") == F.col("l_orderkey"), "left").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return d.select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.log10("o_totalprice").alias("price"), F.col("nl").cast("double").alias("nl"),
        F.log10(F.col("e") / 100.0).alias("ext"), (F.col("d") / F.col("nl")).alias("disc"), (F.col("q") / F.col("nl")).alias("qty"),
        F.when(F.col("c_acctbal").between(0, 10000), F.col("c_acctbal")).alias("acct"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).when(F.col("o_orderstatus") == "P", 3).otherwise(0).alias("st"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("pr"))


def stats_of(df: DataFrame, dims=DIMS) -> dict[str, tuple[float, float]]:
    """Centre and scale of each dimension: a row each."""
    return {r["dim"]: (r["center"], r["scale"]) for r in dim_stats(df, list(dims)).collect()}


#: The same tables in SQL: facts, and per dimension c_ (centre) and s_ (scale) in one row named st8.
SQL = f"""lines AS (
  SELECT l_orderkey, count(*) AS nl, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS e, sum(round(l_discount * 100)::BIGINT)::BIGINT AS d, sum(l_quantity::BIGINT)::BIGINT AS q
  FROM lineitem GROUP BY l_orderkey),
facts AS (
  SELECT o_orderkey AS k, o_custkey AS cust, log10(o_totalprice) AS price, nl::DOUBLE AS nl, log10(e / 100.0::DOUBLE) AS ext, d::DOUBLE / nl AS disc, q::DOUBLE / nl AS qty,
    CASE WHEN c_acctbal BETWEEN 0 AND 10000 THEN c_acctbal END AS acct,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 ELSE 0 END AS st, substr(o_orderpriority, 1, 1)::INTEGER AS pr
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey),
med AS (SELECT {', '.join(f'median({d}) AS c_{d}' for d in DIMS)} FROM facts),
st8 AS (SELECT {', '.join(f'any_value(c_{d}) AS c_{d}, 1.4826 * median(abs({d} - c_{d})) AS s_{d}' for d in DIMS)} FROM facts, med)"""


def sql_axis(weights) -> str:
    return " + ".join(f"{w!r} * coalesce(({k} - c_{k}) / s_{k}, 0.0)" for k, w in weights if w)
