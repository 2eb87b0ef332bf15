"""Helpers that every training-data operator shares: tables, shared scratch storage, components, priors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismview.functions.shared import discard, forget, importable, ranked, scratch, settled, shared_dir, table  # noqa: F401

#: White space of the word rule: blank and the five ASCII controls tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of an Arrow batch of whole documents: few, since one text may hold many thousand words.
TEXTS = 512


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RE + "+", -1))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it inside further lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of an undirected graph.

    edges: columns a, b (long). Returns node, component: the smallest node that can be reached. Nodes
    without an edge aren't in the result. Every round hooks each node's label to the smallest label among
    its neighbours and then jumps to the label's own label, so the rounds grow with the logarithm of the
    longest path; both tables are written in each round. Where no neighbour has a smaller label, all labels are final. Hubs cost nothing special: the minimum per node is
    combined before the shuffle, and the two joins have written tables on both sides, so Spark can split them.
    """
    pair = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = settled(pair.union(pair.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    label = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-0")
    k = 0
    while True:
        k += 1
        around = both.join(label, both.b == label.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = settled(label.join(around, "node", "left").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component")), f"{name}-{k}a", label)
        if hooked.where("component <> was").limit(1).count() == 0:
            forget(both)
            return hooked.select("node", "component")
        # a label is itself a node, and its own label is never larger
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("next"))
        label = settled(hooked.join(jump, "component", "left").select("node", F.least("component", "next").alias("component")), f"{name}-{k}b", hooked)


#: Strips on either side of the limit in ``beta_above``.
STRIPS = 96


def beta_above(a: Column, b: Column, limit: float) -> Column:
    """Probability that a rate with the posterior Beta(a, b) is over limit, for a and b over 0.

    As a function of t = log(x / (1 - x)) the density is x^a (1 - x)^b up to a factor: smooth, with its peak at log(a / b) and
    tails that fall like exp(a t) and exp(-b t). Each side of the limit, out to where the density is nil, is the trapezoid sum of
    ``STRIPS`` strips; the ratio needs no gamma function.
    """
    at = math.log(limit / (1 - limit))
    peak, wide = F.log(a / b), 10 * F.sqrt((a + b) / (a * b))
    ends = (peak - F.greatest(wide, 40 / a), peak + F.greatest(wide, 40 / b))
    top = a * F.log(a / (a + b)) + b * F.log(b / (a + b))

    def side(end: Column) -> Column:
        def height(k: Column) -> Column:
            t = at + (end - at) * k / STRIPS
            bend = F.log1p(F.exp(-F.abs(t)))  # log x = min(t, 0) - bend, log (1 - x) = min(-t, 0) - bend
            return F.exp(a * (F.least(t, F.lit(0.0)) - bend) + b * (F.least(-t, F.lit(0.0)) - bend) - top) * F.when((k == 0) | (k == STRIPS), 0.5).otherwise(1.0)

        return F.aggregate(F.sequence(F.lit(0), F.lit(STRIPS)), F.lit(0.0), lambda s, k: s + height(k)) * F.abs(end - at) / STRIPS

    below, above = (side(e) for e in ends)
    return F.when(ends[0] >= at, 1.0).when(ends[1] <= at, 0.0).otherwise(above / (below + above))


def beta_above_sql(a: str, b: str, limit: float) -> str:
    """``beta_above`` in the SQL that the queries are held against."""
    at = math.log(limit / (1 - limit))
    wide = f"10 * sqrt(({a} + {b}) / ({a} * {b}))"
    left, right = f"(ln({a} / {b}) - greatest({wide}, 40 / ({a})))", f"(ln({a} / {b}) + greatest({wide}, 40 / ({b})))"
    top = f"({a} * ln({a} / ({a} + {b})) + {b} * ln({b} / ({a} + {b})))"

    def side(end: str) -> str:
        t = f"({at} + ({end} - {at}) * k / {STRIPS})"
        bend = f"ln(1 + exp(-abs({t})))"
        return (f"(list_sum(list_transform(range({STRIPS + 1}), lambda k: exp({a} * (least({t}, 0) - {bend}) + {b} * (least(-{t}, 0) - {bend}) - {top})"
                f" * CASE WHEN k IN (0, {STRIPS}) THEN 0.5 ELSE 1 END)) * abs({end} - {at}))")

    return f"(CASE WHEN {left} >= {at} THEN 1.0 WHEN {right} <= {at} THEN 0.0 ELSE {side(right)} / ({side(left)} + {side(right)}) END)"


def beta_strength(units: DataFrame, n: str, bad: str, low: float = 1.0, high: float = 1000.0) -> tuple[float, float]:
    """(mean, strength) of the beta prior from which the units' rates come, by the method of moments.

    Units with n = 0 tell nothing. The one row of sums is all that reaches the driver. Without any
    observation the mean is 0.5; without spread beyond chance the strength is ``high``.
    """
    c, x = F.col(n).cast("double"), F.col(bad).cast("double")
    r = units.where(F.col(n) > 0).agg(F.count("*").alias("h"), F.sum(c).alias("n"), F.sum(x).alias("x"), F.sum(x * x / c).alias("q")).first()
    if not r["h"]:
        return 0.5, low
    mean, share = r["x"] / r["n"], r["h"] / r["n"]
    if mean <= 0 or mean >= 1 or share >= 1:
        return mean, high if share < 1 else low
    spread = (r["q"] / r["n"] - mean * mean) / (mean * (1 - mean))
    rho = min(1 / (1 + low), max(1 / (1 + high), (spread - share) / (1 - share)))
    return mean, 1 / rho - 1
