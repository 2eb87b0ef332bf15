r"""Secret scans by an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by its SHA-256. A ledger holds, for each pair of blob and rule version that
was ever scanned, the spans found; a scan takes one holder of each blob whose pair the ledger lacks, and the
findings are joined back to every path that holds the blob. Matches become rows, so that running sums, overlaps and the
lists of spans take time in proportion to a text and its matches.

Edge cases: a null text is the empty text; null and repeated paths stay as they are; an empty table gives an empty
result; further columns are dropped by the scan and kept by the redaction, whatever their names. Places are in code points,
the end exclusive. Texts are read twice, to address them and to scan one holder of each; an input that gives other rows at
the second reading (a sample, say) is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismview.llm.common import fresh, let, settled, table

#: Kinds in order: (kind, regular expression, group that has to be long, its least length). Fixed values; letters of
#: either case are spelled out, so that case folding can't differ between engines. The first three are the base
#: kinds. A maximal run of 24 characters or more is the same as the matches of the open-ended run that are that
#: long, so those minima stand in the expression; a short ``assign`` value takes its text away from later matches,
#: so that minimum is tested afterwards.
WORD = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
RULES = (
    ("assign", WORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 1),
)
BASE = ("assign", "access", "hex")
#: Kinds whose span is their group, at the match's end: what stands before it only says where it may start. Without that a text
#: of one long run would be read to the run's end from each place in it.
BARE = ("jwt",)
RULE_VERSION = "rules-1.1"
SPAN = "struct<start:int,kind:int,end:int>"
MATCH = "struct<kind:int,i:int,gap:int,long:int,value:int>"


def matches(text: Column, k: int, rule: tuple[str, str, int, int]) -> Column:
    """Array of (kind number, number, length of the text since the last match, length, length of the group) of one kind's
    leftmost matches that don't overlap. The matches and the pieces between them take turns in the text."""
    _, pattern, group, _ = rule

    def measured(m):
        pieces = F.split(text, pattern, -1)
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else m
        both = F.arrays_zip(m.alias("m"), F.slice(pieces, 1, F.size(m)).alias("p"), values.alias("v"))
        row = lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("long"), F.length(x["v"]).alias("value"))
        return F.when(F.size(m) == 0, F.array().cast(f"array<{MATCH}>")).otherwise(F.transform(both, row))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), measured)


def scanned(blobs: DataFrame, rules=RULES) -> DataFrame:
    """blob, spans: the spans of all kinds by start, then kind as listed, for a table of blob and text (each blob once)."""
    found = settled(blobs.select("blob", F.concat(*[matches(F.col("text"), k, r) for k, r in enumerate(rules)]).alias("found")), "secret-matches")
    some = found.where(F.size("found") > 0).select("blob", F.explode("found").alias("m")).select("blob", "m.*")
    upto = Window.partitionBy("blob", "kind").orderBy("i")  # the matches of one text, as they come
    placed = some.withColumn("end", F.sum(F.col("gap") + F.col("long")).over(upto).cast("int"))
    least = F.get(F.array(*[F.lit(r[3]) for r in rules]), F.col("kind"))
    bare = F.get(F.array(*[F.lit(r[0] in BARE) for r in rules]), F.col("kind"))
    span = F.when(F.col("value") >= least, F.struct((F.col("end") - F.when(bare, F.col("value")).otherwise(F.col("long"))).alias("start"), "kind", "end"))
    lists = placed.groupBy("blob").agg(F.array_sort(F.collect_list(span)).cast(f"array<{SPAN}>").alias("spans"))
    none = found.where(F.size("found") == 0).select("blob", F.array().cast(f"array<{SPAN}>").alias("spans"))
    return lists.union(none)


def _name(kind: Column) -> Column:
    return F.get(F.array(*[F.lit(r[0]) for r in RULES]), kind)


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", _name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def unseen_blobs(versions: DataFrame, path: str, text: str, ledger: DataFrame | None, rule_version: str) -> DataFrame:
    """blob, text: one holder's text for each blob that the ledger hasn't met under this rule version.

    Only blob and row number are grouped; the holder's text moves once, to the row number that was chosen.
    """
    numbered = versions.select(F.monotonically_increasing_id().alias("_row"), F.col(text).alias("text"))
    keys = numbered.select("_row", address(F.col("text")).alias("blob"))
    todo = keys.groupBy("blob").agg(F.min("_row").alias("_row"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct()
        todo = todo.join(seen, "blob", "left_anti")
    held = todo.hint("shuffle_hash").join(numbered, "_row")
    same = F.when(F.col("blob") == address(F.col("text")), F.coalesce("text", F.lit(""))).otherwise(F.raise_error(F.lit("the input's rows changed between two readings; write it first")))
    return held.select("blob", same.alias("text"))


def scan_ledger(versions: DataFrame, path: str = "doc_id", text: str = "text", ledger: DataFrame | None = None,
                rule_version: str = RULE_VERSION) -> DataFrame:
    """The ledger with every blob of versions in it: blob, rule_version, spans (written to the shared folder)."""
    new = unseen_blobs(versions, path, text, ledger, rule_version)
    new = settled(scanned(new).select("blob", F.lit(rule_version).alias("rule_version"), "spans"), "ledger")
    return new if ledger is None else ledger.select("blob", "rule_version", "spans").unionByName(new)


def secret_scans(versions: DataFrame, path: str = "doc_id", text: str = "text", ledger: DataFrame | None = None,
                 rule_version: str = RULE_VERSION) -> DataFrame:
    """path, spans for every row of versions: what the ledger holds for its blob."""
    found = scan_ledger(versions, path, text, ledger, rule_version).where((F.col("rule_version") == rule_version) & (F.size("spans") > 0))
    found = found.select(F.col("blob").alias("_blob"), "spans")
    keys = versions.select(F.col(path).alias(path), address(F.col(text)).alias("_address"))
    return keys.join(found, keys["_address"] == found["_blob"], "left").select(path, F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def digest(found: DataFrame, path: str = "doc_id") -> DataFrame:
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(path, *[count(k).alias(f"n_{r[0]}") for k, r in enumerate(RULES[:3])],
                        F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def merged(found: DataFrame) -> DataFrame:
    """blob, spans: overlapping spans of a blob as one, by start."""
    each = found.select("blob", F.explode("spans").alias("s")).select("blob", "s.start", "s.end")
    order = Window.partitionBy("blob").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = each.withColumn("new", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    whole = islands.groupBy("blob", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def redacted(docs: DataFrame, found: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text replaced by mark, overlapping spans by one. found: blob and spans (a ledger). A text with
    spans is taken apart into characters once, and the parts between the spans are put together."""
    blob, spans, own = (fresh(docs, c) for c in ("blob", "spans", "address"))
    hit = settled(merged(found.where(F.size("spans") > 0)), "secret-places").select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    t, m = F.col(text), F.col(spans)
    end = lambda i: F.coalesce(F.get(m, i)["end"], F.lit(0))
    part = lambda chars, a, z: F.array_join(F.slice(chars, a + 1, z - a), "")
    cut = lambda chars: F.concat(F.array_join(F.transform(m, lambda x, i: F.concat(part(chars, end(i - 1), x["start"]), F.lit(mark))), ""), part(chars, end(F.size(m) - 1), F.size(chars)))
    held = docs.withColumn(own, address(t)).join(hit.hint("shuffle_hash"), F.col(own) == F.col(blob), "left")
    return held.withColumn(text, F.when(m.isNull(), t).otherwise(let(F.split(t, "", -1), cut))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in two increments: the versions of the first half of the addresses, then all of them against that ledger."""
    docs = table(spark, sf_dir, "documents")
    first = scan_ledger(docs.where(address(F.col("text")) < "8"))
    return digest(secret_scans(docs, ledger=first))


def _sql_kind(kind: str, k: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    start = "s + length(m) - length(v)" if kind in BARE else "s"
    return f"""
  SELECT doc_id, {k} AS k, '{kind}' AS kind, {start} AS s, s + length(m) AS e FROM (
    SELECT doc_id, m, v, coalesce(sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(p) AS s
    FROM (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(ps[1:len(ms)]) AS p
      FROM (SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {group}) AS vs, regexp_split_to_array(t, '{p}') AS ps FROM d)))
  WHERE length(v) >= {least}"""


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(_sql_kind(r[0], k, *r[1:]) for k, r in enumerate(RULES))}),
grouped AS (
  SELECT doc_id, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN grouped USING (doc_id)
"""
