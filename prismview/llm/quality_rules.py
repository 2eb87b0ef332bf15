"""Quality rules with a host-level verdict, in DataFrame functions only.

Edge cases: a null or empty text has no words, so it fails the base rules; null hosts form one host of
their own; rows with equal ids stay separate rows; an empty table gives an empty result; further columns
of the input are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismview.llm.common import SPACE_RE, beta_above, beta_above_sql, beta_strength, let, settled, table, words


def _windows(w: Column, n: Column, width: int) -> Column:
    hashed = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), hashed)).otherwise(F.array().cast("array<bigint>"))


def _covered(wins: Column, width: int) -> Column:
    """Words in windows that occur twice or more: sort (window, place), keep those equal to a neighbour, add up the gaps."""
    def marked(s):
        twin = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))

    def total(p):
        step = F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(width)), F.lit(width)))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.array_sort(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(pairs, marked), total)


def rule_counts(docs: DataFrame, text: str = "text", width: int = 5) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words for the whole text.

    Windows are compared by their 64-bit hash within one text, so the counts are exact up to a collision of hashes. The exact cover of the repeats is worked out
    only where a text has a repeated window at all.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.withColumn("_w", words(F.col(text))).withColumn("n_words", F.size("_w").cast("long")).withColumn("_lines", lines)
    two = (one.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
           .withColumn("n_symbols", F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"))
           .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
           .withColumn("_win", _windows(F.col("_w"), F.col("n_words").cast("int"), width)).drop("_lines", "_w"))
    some = F.size("_win") > F.size(F.array_distinct("_win"))
    return two.withColumn("n_repeat_words", F.when(some, _covered(F.col("_win"), width)).otherwise(F.lit(0).cast("long"))).drop("_win")


def host_verdicts(counts: DataFrame, host: str, failed: str, limit: float = 0.5, sure: float = 0.95) -> DataFrame:
    """host, n, bad, rate, over, rejected: each host's failure rate shrunk to the prior of all hosts.

    A host is rejected where its posterior rate is over limit with a probability (over) above sure: the lower bound of the
    beta posterior is over limit.
    """
    units = settled(counts.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.count_if(F.col(failed)).alias("bad")), "hosts")
    mean, strength = beta_strength(units, "n", "bad")
    rate = (F.col("bad") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    weight = F.col("n") + F.lit(strength)
    over = F.when(F.col("rate") <= 0, 0.0).when(F.col("rate") >= 1, 1.0).otherwise(beta_above(F.col("rate") * weight, (1 - F.col("rate")) * weight, limit))
    return units.withColumn("rate", rate).withColumn("over", over).withColumn("rejected", F.col("over") > sure)


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", limit: float = 0.5) -> DataFrame:
    """key, the five counts, base_failed and kept for every row of docs.

    Base rules: fewer than 10 words, or over a fifth of the words in repeated 5-word windows. A document
    that passes them is kept unless its host is rejected.
    """
    few = docs.select(F.col(key).alias("_key"), F.col(host).alias("_host"), F.col(text).alias("_text"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counts = settled(rule_counts(few, "_text").drop("_text").withColumn("base_failed", failed), "quality-rules")
    bad = host_verdicts(counts, "_host", "base_failed", limit).where("rejected").select(F.col("host").alias("_bad"))
    hit = counts.join(bad, counts["_host"].eqNullSafe(bad["_bad"]), "left").withColumn("_out", F.col("_bad").isNotNull())
    if counts.where(F.col("_host").isNull()).limit(1).count():  # a null host finds its verdict by the null-safe key, and then shows as null
        null_out = bad.where("_bad is null").limit(1).count() > 0
        hit = hit.withColumn("_out", F.when(F.col("_host").isNull(), F.lit(null_out)).otherwise(F.col("_out")))
    return hit.select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & ~F.col("_out")).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
wins AS (
  SELECT d.doc_id, i, array_to_string(d.ws[i:i + 4], ' ') AS h
  FROM w d, unnest(generate_series(1, len(d.ws) - 4)) AS g(i) WHERE len(d.ws) >= 5),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM wins) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, unnest([0, 1, 2, 3, 4]) AS o(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN cover USING (doc_id)),
base AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM counts),
hosts AS (SELECT source, count(*) AS n, count_if(base_failed) AS bad FROM base GROUP BY source),
sums AS (SELECT count(*)::DOUBLE AS h, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS x, sum(bad::DOUBLE * bad / n) AS q FROM hosts),
prior AS (
  SELECT x / n AS mean, CASE WHEN x <= 0 OR x >= n THEN 1000.0 ELSE
    1 / least(0.5, greatest(1 / 1001.0, ((q / n - x / n * x / n) / (x / n * (1 - x / n)) - h / n) / (1 - h / n))) - 1 END AS m FROM sums),
post AS (SELECT source, (bad + mean * m) / (n + m) AS rate, bad + mean * m AS a, n - bad + (1 - mean) * m AS b FROM hosts, prior),
verdict AS (SELECT source, (CASE WHEN rate <= 0 THEN 0.0 WHEN rate >= 1 THEN 1.0 ELSE {beta_above_sql('a', 'b', 0.5)} END) > 0.95 AS rejected FROM post)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT rejected) AS kept
FROM base JOIN verdict ON base.source IS NOT DISTINCT FROM verdict.source
"""
