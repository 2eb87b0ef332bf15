"""URL filters: explicit host and path rules, then an empirical-Bayes reputation of hosts; DataFrame functions only.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the
reputation of the empty host; null page ids stay and find no label; labels repeated for a page all count;
pages repeated stay repeated; empty tables give empty results (no label at all: every rate is 0.5, nothing is
blocked); a port is part of the host column, but not of the name that outcomes are gathered under; further columns are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismview.llm.common import ascii_lower, beta_above, beta_above_sql, beta_strength, settled, table

#: The rules of the production list: (host and path, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
URL = r"://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: the host after the first ``://`` with A-Z lowered, the path up to ``?`` or ``#``."""
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, URL, 1)), F.regexp_extract(u, URL, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does. The rules are part of the plan: keep them to a few hundred."""
    rule = verdict = F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        top, slash, rest = text.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


#: Suffixes of the production list with more than one label; the last label of a host is one in any case.
SUFFIXES = ("co.uk", "org.uk", "com.au", "co.jp", "com.br")
ADDRESS = r"^([0-9]+(\.[0-9]+){3}|\[.*\])$"


def host_key(host: Column) -> Column:
    """The host without its port, under which outcomes are gathered."""
    return F.regexp_replace(host, ":[0-9]*$", "")


def registered_domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """hosts (different hosts in ``host``) with ``suffix``, the longest one in suffixes (a column suffix) that the host ends in, else its last
    label, and ``domain``, the suffix and the label before it. A host that is a suffix itself is its own domain; so is a numeric address, under the
    suffix ``ip``."""
    if suffixes is None:
        suffixes = hosts.sparkSession.createDataFrame([(s,) for s in SUFFIXES], "suffix string")
    known = settled(suffixes.select(ascii_lower(F.col("suffix")).alias("_suffix")).where("_suffix is not null").distinct(), "url-suffix-list")
    deepest = known.agg(F.max(F.size(F.split("_suffix", r"\.")))).first()[0] or 1
    tail = lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n)
    ends = hosts.select("host", F.explode(F.sequence(F.lit(1), F.lit(deepest))).alias("_n")).where(F.col("_n") <= F.size(F.split("host", r"\.")))
    ends = ends.select(F.col("host").alias("_of"), "_n", tail(F.col("_n")).alias("_tail"))
    fits = ends.join(known, ends["_tail"] == known["_suffix"]).groupBy("_of").agg(F.max("_n").alias("_labels"))
    labels, address = F.coalesce("_labels", F.lit(1)), F.col("host").rlike(ADDRESS)
    got = hosts.join(fits, hosts["host"] == fits["_of"], "left")
    return (got.withColumn("suffix", F.when(address, "ip").otherwise(tail(labels))).withColumn("domain", F.when(address, F.col("host")).otherwise(tail(labels + 1)))
            .drop("_of", "_labels"))


def reputation(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """host, n, rate, strength for a table of host (each once), n (labelled pages), bad.

    The rate of a suffix is shrunk to the global mean, that of a registered domain to its suffix, that of a host
    to its domain. The strength of each step's beta-binomial prior comes from the spread of the rates on its level.
    """
    h = settled(registered_domains(settled(hosts, "url-host-counts"), suffixes), "url-hosts")
    d = settled(h.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("db")), "url-domains")
    s = settled(d.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb")), "url-suffixes")
    mean, ms = beta_strength(s, "sn", "sb")
    md, mh = beta_strength(d, "dn", "db")[1], beta_strength(h, "n", "bad")[1]
    s = s.select("suffix", ((F.col("sb") + F.lit(mean * ms)) / (F.col("sn") + F.lit(ms))).alias("rs"))
    d = d.join(s, "suffix").select("domain", ((F.col("db") + md * F.col("rs")) / (F.col("dn") + F.lit(md))).alias("rd"))
    rate = (F.col("bad") + mh * F.col("rd")) / (F.col("n") + F.lit(mh))
    return h.join(d, "domain").select("host", "n", rate.alias("rate"), F.lit(mh).alias("strength"))


def url_filters(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = 0.5, sure: float = 0.95, suffixes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every page.

    outcomes: page_id and bad (boolean), the labelled pages. suffixes: a column suffix, the public suffixes of several labels. Where no rule fits, a page is blocked if its
    host's posterior rate of bad pages is over limit with a probability over sure, that is, if the posterior's lower bound is.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = parts.join(outcomes.select(F.col("page_id").alias("_id"), F.col("bad").alias("_bad")), F.col("page_id") == F.col("_id"), "left")
    hosts = seen.groupBy(host_key(F.col("host")).alias("host")).agg(F.count("_bad").alias("n"), F.count_if("_bad").alias("bad"))
    known = reputation(hosts, suffixes).withColumn("weight", F.col("n") + F.col("strength"))
    over = (F.when(F.col("rate") <= 0, 0.0).when(F.col("rate") >= 1, 1.0)
            .otherwise(beta_above(F.col("rate") * F.col("weight"), (1 - F.col("rate")) * F.col("weight"), limit)))
    judged = settled(known.select(F.col("host").alias("_host"), F.when(over > sure, "block").otherwise("allow").alias("_verdict")), "url-verdicts")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (parts.join(judged, host_key(parts["host"]) == judged["_host"], "left")
            .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "_verdict").alias("verdict")))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages take the outcome that labels hold under their number: bad means low quality or toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filters(table(spark, sf_dir, "pages"), labels)


def _strength(level: str, n: str, bad: str) -> str:
    return f"""(SELECT CASE WHEN h IS NULL OR h = 0 THEN 1.0 WHEN h >= n THEN 1.0 WHEN x <= 0 OR x >= n THEN 1000.0 ELSE
      1 / least(0.5, greatest(1 / 1001.0, ((q / n - x / n * x / n) / (x / n * (1 - x / n)) - h / n) / (1 - h / n))) - 1 END
      FROM (SELECT count(*)::DOUBLE AS h, sum({n})::DOUBLE AS n, sum({bad})::DOUBLE AS x, sum({bad}::DOUBLE * {bad} / {n}) AS q FROM {level} WHERE {n} > 0))"""


SQL = rf"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(rule, said) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
cut AS (SELECT rule, said, split_part(rule, '/', 1) AS top, substr(rule, strpos(rule, '/')) AS rest FROM rules),
fit AS (
  SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(said, length(rule)) AS said
  FROM (SELECT DISTINCT host, path FROM parts) JOIN cut ON (host = top OR ends_with(host, '.' || top)) AND starts_with(path, rest) GROUP BY host, path),
h0 AS (
  SELECT regexp_replace(host, ':[0-9]*$', '') AS host, count(bad) AS n, count_if(bad) AS bad
  FROM parts LEFT JOIN (SELECT doc_id, (quality = 0 OR toxic = 1) AS bad FROM labels) ON page_id = doc_id GROUP BY 1),
h1 AS (SELECT *, string_split(host, '.') AS p FROM h0),
h2 AS (SELECT host, n, bad, array_to_string(p[-2:], '.') AS two, array_to_string(p[-3:], '.') AS three FROM h1),
h3 AS (SELECT *, regexp_full_match(host, '[0-9]+(\.[0-9]+){{3}}|\[.*\]') AS address, two IN ('co.uk', 'org.uk', 'com.au', 'co.jp', 'com.br') AS wide FROM h2),
h AS (SELECT host, n, bad, CASE WHEN address THEN host WHEN wide THEN three ELSE two END AS domain, CASE WHEN address THEN 'ip' WHEN wide THEN two ELSE string_split(two, '.')[-1] END AS suffix FROM h3),
d AS (SELECT domain, suffix, sum(n)::BIGINT AS dn, sum(bad)::BIGINT AS db FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(dn)::BIGINT AS sn, sum(db)::BIGINT AS sb FROM d GROUP BY suffix),
m AS (SELECT {_strength('s', 'sn', 'sb')} AS ms, {_strength('d', 'dn', 'db')} AS md, {_strength('h', 'n', 'bad')} AS mh,
  (SELECT CASE WHEN coalesce(sum(sn), 0) = 0 THEN 0.5 ELSE sum(sb)::DOUBLE / sum(sn) END FROM s) AS mean),
s2 AS (SELECT suffix, (sb + mean * ms) / (sn + ms) AS rs FROM s, m),
d2 AS (SELECT domain, (db + md * rs) / (dn + md) AS rd FROM d JOIN s2 USING (suffix), m),
h4 AS (SELECT host, n, (bad + mh * rd) / (n + mh) AS rate, mh FROM h JOIN d2 USING (domain), m),
h5 AS (SELECT host, rate, rate * (n + mh) AS a, (1 - rate) * (n + mh) AS b FROM h4),
v AS (SELECT host, CASE WHEN (CASE WHEN rate <= 0 THEN 0.0 WHEN rate >= 1 THEN 1.0 ELSE {beta_above_sql('a', 'b', 0.5)} END) > 0.95 THEN 'block' ELSE 'allow' END AS verdict FROM h5)
SELECT page_id, host, path, rule, coalesce(said, verdict) AS verdict
FROM parts LEFT JOIN fit USING (host, path) JOIN (SELECT host AS key, verdict FROM v) ON regexp_replace(host, ':[0-9]*$', '') = key
"""
