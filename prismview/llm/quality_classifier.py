"""Quality classifier: hierarchical empirical Bayes over document evidence, hosts and paths.

A document's evidence is the log likelihood ratio of a few discretised text measures, from counts of (measure,
level, label) over all labelled documents. One measure is what the document's words tell: words are hashed into ``BUCKETS``
buckets, a bucket's share of bad documents is shrunk to the share of all words, and the lower bound of its posterior, as
log odds over that share, is the word's weight if it is ``TELLING`` or more. A document's own label is left out of the
counts that weigh its words. The share of good documents of a host is shrunk to the global share, that of
a path to its host's, by beta priors whose strength comes from the spread between hosts and between paths. Evidence
plus the log odds of the path's posterior share is the score; a document is kept at ``least`` or more. All counts are
grouped aggregates over all rows; only the table of measures and levels (fixed size), the buckets that tell of bad
documents (``BUCKETS`` rows of three numbers at most, 6 MB) and a few sums reach the driver, and the buckets the tasks.

Edge cases: a null or empty text has zero measures; null hosts and paths count as a host and path of their own; a null
id is scored but finds no label; several labels of a document all count; repeated rows stay; without labels all scores
are 0 and everything is kept; an empty table gives an empty result; further columns are dropped, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismview.llm.common import TEXTS, beta_strength, settled, table

#: (measure, what it counts, per what). Levels are whole steps of the binary logarithm.
MEASURES = (("length", "n_words", None), ("symbols", "n_symbols", "n_words"), ("capitals", "n_upper", "n_letters"), ("bars", "n_bars", "n_words"),
            ("echoes", "n_echoes", "n_words"), ("variety", "n_distinct", "n_words"), ("digits", "n_digits", "n_bytes"), ("lines", "n_repeated_lines", "n_lines"))
COUNTS = ("n_bytes", "n_words", "n_symbols", "n_upper", "n_letters", "n_bars", "n_echoes", "n_distinct", "n_digits", "n_lines", "n_repeated_lines")
LEVELS = 24
BUCKETS = 1 << 18
TELLING = 0.5
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
SPREAD = (0.1, 0.2, 0.4, 0.2, 0.1)
SYMBOLS = np.frombuffer(b"#*$%&<>!", dtype=np.uint8)


def counts_of(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS."""
    b = (text or "").encode()
    h = np.bincount(np.frombuffer(b, dtype=np.uint8), minlength=256)
    upper = int(h[65:91].sum())
    w, lines = b.split(), [x for x in b.split(b"\n") if x.strip()]
    echoes = sum(map(bytes.__eq__, w, w[1:]))
    return (len(b), len(w), int(h[SYMBOLS].sum()), upper, upper + int(h[97:123].sum()), int(h[124]), echoes, len(set(w)), int(h[48:58].sum()), len(lines), len(lines) - len(set(lines)))


def buckets_of(text: str | None) -> np.ndarray:
    """The buckets of a text's words (lower case, without ASCII punctuation around them), every bucket once."""
    w = {x.strip(EDGES) for x in (text or "").lower().split()} - {""}
    return np.unique(np.fromiter((zlib.crc32(x.encode()) % BUCKETS for x in w), dtype=np.int32, count=len(w)))


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep, the counts and the word buckets of every row."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            found = np.array([counts_of(t) for t in texts], dtype=np.int64).reshape(-1, len(COUNTS))
            in_buckets = [buckets_of(t) for t in texts]
            ends = np.cumsum([0, *map(len, in_buckets)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *in_buckets])))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], *[pa.array(found[:, i]) for i in range(len(COUNTS))], lists], [*keep, *COUNTS, "buckets"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, kinds + "".join(f", {c} long" for c in COUNTS) + ", buckets array<int>")


def level(what: str, per: str | None) -> Column:
    x = F.col(what).cast("double") if per is None else 1024.0 * F.col(what) / F.greatest(F.col(per), F.lit(1))
    return F.least(F.floor(F.log2(x + 1)).cast("int"), F.lit(LEVELS - 1))


#: The level of every measure.
LEVEL = {**{m: (w, p) for m, w, p in MEASURES}, "words": None}


def level_of(measure: str) -> Column:
    return level(*LEVEL[measure]) if LEVEL[measure] else F.col("word_level")


def lower(good, bad, mean: float, root, prior: float = 20.0, z: float = 3.0):
    """Lower bound of the posterior share of bad documents, with a prior of ``prior`` documents at the mean; for columns and arrays."""
    n = good + bad + prior
    r = (bad + prior * mean) / n
    return r - z * root(r * (1 - r) / (n + 1))


def telling_buckets(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """(bucket, good, bad) in the order of buckets for those that may tell, and the mean share of bad documents over all words."""
    counts = settled(labelled.select(F.explode("buckets").alias("bucket"), "n_good", "n_bad")
                     .groupBy("bucket").agg(F.sum("n_good").alias("good"), F.sum("n_bad").alias("bad")), "quality-buckets")
    total = counts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not total["good"] or not total["bad"]:
        return np.zeros((3, 0), dtype=np.int64), 0.5
    mean = total["bad"] / (total["good"] + total["bad"])
    least = 1 / (1 + np.exp(-TELLING) * (1 - mean) / mean)
    # one label less than there are, since a document's own doesn't count
    over = counts.where(lower(F.greatest(F.col("good") - 1, F.lit(0)), F.col("bad"), mean, F.sqrt) >= float(least)).collect()
    return np.array(sorted((r["bucket"], r["good"], r["bad"]) for r in over), dtype=np.int64).reshape(-1, 3).T, mean


def word_levels(seen: DataFrame, told: np.ndarray, mean: float, keep: list[str]) -> DataFrame:
    """The columns keep with word_level: the binary logarithm of the weights of a row's words, added up; 0 if no word tells."""
    kinds = ", ".join(f"`{c}` {seen.schema[c].dataType.simpleString()}" for c in keep)
    bucket, good, bad = told

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, own_good, own_bad = (b.column(len(keep) + i) for i in range(3))
            total = np.zeros(b.num_rows)
            if len(bucket):
                words, row = lists.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                at = np.minimum(np.searchsorted(bucket, words), len(bucket) - 1)
                hit = bucket[at] == words
                at, row = at[hit], row[hit]
                low = np.clip(lower(good[at] - own_good.to_numpy()[row], bad[at] - own_bad.to_numpy()[row], mean, np.sqrt), 1e-9, 1 - 1e-9)
                weight = np.log(low / (1 - low)) - np.log(mean / (1 - mean))
                total = np.bincount(row, np.where(weight >= TELLING, weight, 0), b.num_rows)
            found = np.minimum(np.ceil(np.log2(1 + 4 * total)), LEVELS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(found)], [*keep, "word_level"])

    return seen.select(*keep, "buckets", F.col("n_good").alias("_good"), F.col("n_bad").alias("_bad")).mapInArrow(run, kinds + ", word_level int")


def evidence(labelled: DataFrame, prior: float = 0.2) -> dict[str, list[float]]:
    """Log likelihood ratio good : bad for every measure's levels.

    Counts are spread over neighbouring levels (not those of the words, whose level zero means that no word tells) and shrunk to the distribution of all documents (``prior`` times the number
    of levels), so that a level that few labels show tells little.
    """
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), level_of(m).alias("level")) for m in LEVEL])).alias("x")
    rows = labelled.select("n_good", "n_bad", each).groupBy("x.measure", "x.level").agg(F.sum("n_good").alias("good"), F.sum("n_bad").alias("bad")).collect()
    out = {}
    for m in LEVEL:
        counts = np.zeros((2, LEVELS))
        for r in rows:
            if r["measure"] == m:
                counts[:, r["level"]] = r["good"], r["bad"]
        if not counts.sum(axis=1).all():
            out[m] = [0.0] * LEVELS
            continue
        counts = np.array([np.convolve(c, SPREAD, "same") for c in counts]) if LEVEL[m] else counts
        pooled = counts.sum(axis=0) + 0.01
        share = counts + prior * LEVELS * pooled / pooled.sum()
        share /= share.sum(axis=1, keepdims=True)
        out[m] = [float(x) for x in np.log(share[0]) - np.log(share[1])]
    return out


def sites(labelled: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, share of good documents after shrinking, for every labelled path; of hosts: path null, whole true; the global share)."""
    p = settled(labelled.groupBy("host", "path").agg(F.sum(F.col("n_good") + F.col("n_bad")).alias("n"), F.sum("n_good").alias("good")), "quality-paths")
    h = settled(p.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "quality-hosts")
    share, mh = beta_strength(h, "n", "good")
    mp = beta_strength(p, "n", "good")[1]
    share = min(max(share, 1e-3), 1 - 1e-3)
    h = h.select("host", ((F.col("good") + F.lit(share * mh)) / (F.col("n") + F.lit(mh))).alias("host_share"))
    both = p.join(h, "host").select("host", "path", "host_share", ((F.col("good") + mp * F.col("host_share")) / (F.col("n") + F.lit(mp))).alias("path_share"))
    return settled(both, "quality-sites"), share


def quality_classifier(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang",
                       least: float = 0.0) -> DataFrame:
    """key, evidence, site_share, score, kept for every row of docs. labels: key and good (boolean)."""
    few = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
                      F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.col(text).alias("_text"))
    known = labels.where("good is not null").groupBy(F.col(key).alias("_label")).agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))
    counted = measured(few, ["_key", "host", "path"], "_text")
    counted = counted.join(known.hint("shuffle_hash"), counted["_key"] == known["_label"], "left").drop("_label").na.fill(0, ["n_good", "n_bad"])
    worded = settled(counted, "quality-measures", rows=TEXTS)
    told, mean = telling_buckets(worded.where("n_good + n_bad > 0"))
    seen = settled(word_levels(worded, told, mean, [c for c in worded.columns if c != "buckets"]), "quality-words", worded, rows=TEXTS)
    labelled = seen.where("n_good + n_bad > 0")
    ratios = evidence(labelled)
    site, share = sites(labelled)
    hosts = site.groupBy("host").agg(F.first("host_share").alias("hs"))
    got = F.lit(0.0)
    for m in LEVEL:
        got = got + F.get(F.array(*[F.lit(x) for x in ratios[m]]), level_of(m))
    places = seen.select("host", "path").distinct().join(site.select("host", "path", "path_share"), ["host", "path"], "left").join(hosts, "host", "left")
    places = settled(places.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.coalesce("path_share", "hs", F.lit(share)).alias("site_share")), "quality-places")
    s = F.col("site_share")
    scored = seen.withColumn("evidence", got).join(places, (seen["host"] == places["_host"]) & (seen["path"] == places["_path"]))
    # without evidence of either kind the odds are even
    odds = F.lit(0.0) if not any(any(x) for x in ratios.values()) else F.log(s / (1 - s))
    return scored.withColumn("score", F.col("evidence") + odds).select(F.col("_key").alias(key), "evidence", "site_share", "score", (F.col("score") >= least).alias("kept"))


def good_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good are labelled documents of quality 1 that aren't toxic; a toxic one is bad whatever its quality, even without one."""
    return table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, False).otherwise(F.col("quality") == 1).alias("good"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), good_labels(spark, sf_dir))
