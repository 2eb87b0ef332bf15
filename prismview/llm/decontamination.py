"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders, so a question that was asked again with other values
has the same template. Windows of ``width`` template tokens are hashed and hash-joined with the windows of the
benchmark; a window counts if most of it is literal words. A document's passage is compared with the item along a
diagonal (its place less the item's), or along a chain of nearby diagonals, since a value of another word count or a word put in
shifts what follows; adjacent placeholders of a kind are one, and the word after a number may be a unit that no list has. The values in the placeholders must map one to one between
the two. A capital that begins a sentence may be a word or a name, so windows with one have both forms. A pair is
contaminated if the windows of the best run or chain, all consistent, are ``share`` of the item's windows or more.

The benchmark's window hashes go to the tasks as a filter if there are at most ``most`` of them (8 bytes each); beyond
that every window of the documents takes part in the join. Either way the join itself decides.

Edge cases: a null or blank text has no windows; items with fewer tokens than ``width`` are one window of their own
length, below ``least`` tokens they find nothing; null ids stay as ids; documents repeated under an id are reported
once; empty tables give an empty result; further columns are dropped, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismview.llm.common import TEXTS, settled, table

WIDTH, LEAST = 8, 5
#: Words taken for units of measure.
UNITS = frozenset(b"mm cm m km in ft yd mi mile miles meter meters metre metres g kg mg lb lbs oz ton tons gram grams pound pounds ml l liter liters "
                  b"litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars "
                  b"euro euros cent cents degree degrees kb mb gb tb".split())
#: Words taken for numbers, alone or joined by hyphens.
NUMBERS = (b"zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
           b"twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen").split()
SPELLED = frozenset(n + s for n in NUMBERS for s in (b"", b"s"))
NUMBER = re.compile(rb"[-+$\xe2\x82\xac\xc2\xa3]*\d[\d.,:/]*%?")
#: So many words in capitals that stand together are names, and so many words for numbers a number; more are words like any other.
TOGETHER = 3
LITERAL, NUMERIC, UNIT, NAME, NOTHING = range(5)
EDGE = re.compile(rb"^[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+$")
_words: list = []


class Words(dict):
    """Number of each raw word; for each number the token's hash, kind, its look (1: a capital, 2: in capitals, 3: a word for a number),
    and whether a sentence ends with the word."""

    def __init__(self):
        from xxhash import xxh64_intdigest

        super().__init__()
        self.digest, self.rows, self.count = xxh64_intdigest, [], 0
        self.values, self.facts = np.zeros(0, np.uint64), np.zeros((0, 3), np.int8)

    def __missing__(self, raw: bytes) -> int:
        core = EDGE.sub(b"", raw)
        low = core.lower()
        spelled = low in SPELLED or b"-" in low and all(x in SPELLED for x in low.split(b"-"))
        kind = NUMERIC if spelled or NUMBER.fullmatch(core) else UNIT if low in UNITS else NOTHING if not core else LITERAL
        word = core.decode(errors="replace") if kind == LITERAL and (low != core or core[:1] > b"~") else ""
        look = 3 * spelled if not word[:1].isupper() else 1 if len(word) == 1 or word[1:].islower() else 2 * word.isupper()
        self.rows.append((self.digest(low), kind, look, raw[-1:] in b".!?"))
        self[raw] = self.count
        self.count += 1
        return self.count - 1

    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        """Values and (kind, look, sentence end) by number, with those met since the last call."""
        if self.rows:
            self.values = np.concatenate([self.values, np.array([r[0] for r in self.rows], dtype=np.uint64)])
            self.facts = np.concatenate([self.facts, np.array([r[1:] for r in self.rows], dtype=np.int8).reshape(-1, 3)])
            self.rows = []
        return self.values, self.facts


def tokens(texts: list[str | None], most: int = 500_000) -> tuple[np.ndarray, ...]:
    """(row, hash of the value, kind, whether a capital begins a sentence, place in the row) of all tokens of the texts, row by row."""
    if not _words or len(_words[0]) > most:
        _words[:] = [Words()]
    known_words = _words[0]
    split = [(t or "").encode().split() for t in texts]
    ids = np.fromiter((i for w in split for i in map(known_words.__getitem__, w)), dtype=np.int64)
    row = np.repeat(np.arange(len(split)), [len(w) for w in split])
    values, known = known_words.columns()
    value, facts = values[ids], known[ids]
    kind, look, ends = facts[:, 0].copy(), facts[:, 1], facts[:, 2] == 1
    capital = (look == 1) | (look == 2)
    first = np.ones(len(ids), dtype=bool)
    first[1:] = ends[:-1] | (row[1:] != row[:-1])
    for alike in (2, 3):
        at = np.flatnonzero(look == alike)
        run = np.cumsum(np.diff(at, prepend=-2) + np.diff(row[at], prepend=0) != 1)  # words that stand together in a text
        many = at[np.bincount(run)[run] > TOGETHER]
        capital[many], kind[many] = False, LITERAL
    kind[capital & ~first] = NAME
    some = kind != NOTHING
    row, value, kind, opens = row[some], value[some], kind[some], (capital & first)[some]
    counts = np.bincount(row, minlength=len(texts))
    return row, value, kind, opens, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def template(row: np.ndarray, value: np.ndarray, kind: np.ndarray, opens: np.ndarray, place: np.ndarray, form: int) -> tuple[np.ndarray, ...]:
    """(row, hash of the template token, hash of the value, kind, whether it differs from the plain form, place): form 0 is plain, in
    form 1 the word after a number is a unit and runs of placeholders of a kind are one token, in form 2 capitals that begin a
    sentence are names as well."""
    kind = np.where(opens, NAME, kind) if form == 2 else kind
    opens = opens & (form == 2)
    if form:
        unit = np.zeros(len(row), dtype=bool)
        unit[1:] = (kind[1:] == LITERAL) & (kind[:-1] == NUMERIC) & (row[1:] == row[:-1])
        kind, opens = np.where(unit, UNIT, kind), opens | unit
    head = np.ones(len(row), dtype=bool)
    head[1:] = (row[1:] != row[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == LITERAL) | (form == 0)
    at = np.flatnonzero(head)
    if not len(at):
        return row, value, value, kind, opens, place
    with np.errstate(over="ignore"):
        nth = (np.arange(len(row)) - np.repeat(at, np.diff(np.append(at, len(row))))).astype(np.uint64)
        whole = np.add.reduceat(value * (nth * np.uint64(0xC4CEB9FE1A85EC52) + np.uint64(1)), at)
        kinds = kind[at]
        hashed = np.where(kinds == LITERAL, whole, kinds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return row[at], hashed, whole, kinds, np.logical_or.reduceat(opens, at) | (np.diff(np.append(at, len(row))) > 1), place[at]


def windows(row: np.ndarray, template: np.ndarray, kind: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first token, hash) of the windows of ``width`` tokens that are mostly literal."""
    n = len(row) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, literal = np.full(n, width, dtype=np.uint64), np.zeros(n, dtype=np.int64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = (h ^ template[k:k + n]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(29)
            literal += kind[k:k + n] == LITERAL
    at = np.flatnonzero((row[:n] == row[width - 1:]) & (literal * 5 >= width * 3))
    return at, h[at]


def window_rows(df: DataFrame, key: str, text: str, widths: list[int], wanted: np.ndarray | None = None, forms: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """key, at, hash, slots of the windows of df's texts (those in wanted, if given; wanted is sorted), in all forms of the template."""
    spark = df.sparkSession
    held = None if wanted is None else spark.sparkContext.broadcast(wanted)
    kind_of = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = None
        if held is not None:
            sieve = np.zeros(1 << 20, dtype=bool)
            sieve[(held.value >> np.uint64(44)).astype(np.int64)] = True
        for b in batches:
            read = tokens(b.column(1).to_pylist())
            for form in forms:
                row, hashed, value, kind, opens, place = template(*read, form)
                opened = np.concatenate([[0], np.cumsum(opens)])
                for width in widths:
                    at, h = windows(row, hashed, kind, width)
                    if form and len(forms) > 1:  # the others are the same in the plain form
                        some = opened[at + width] > opened[at]
                        at, h = at[some], h[some]
                    if sieve is not None:
                        some = np.flatnonzero(sieve[(h >> np.uint64(44)).astype(np.int64)])
                        some = some[np.isin(h[some], held.value)] if len(held.value) else some[:0]
                        at, h = at[some], h[some]
                    for lo in range(0, len(at), 65536):
                        a, hh = at[lo:lo + 65536], h[lo:lo + 65536]
                        slots = [value[i:i + width][kind[i:i + width] != LITERAL].view(np.int64).tolist() for i in a.tolist()]
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[a])), pa.array(place[a].astype(np.int64)), pa.array(hh.view(np.int64)), pa.array(slots, pa.list_(pa.int64())), pa.array(np.full(len(a), form == 0))], ["_key", "at", "hash", "slots", "plain"])

    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind_of}, at long, hash long, slots array<long>, plain boolean")


def token_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, form, n: the template tokens of df's texts in all forms."""
    def run(batches):
        for b in batches:
            read = tokens(b.column(1).to_pylist())
            for form in (0, 1, 2):
                n = np.bincount(template(*read, form)[0], minlength=b.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), form)), pa.array(n)], ["_key", "form", "n"])

    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {df.schema[key].dataType.simpleString()}, form long, n long")


def best_chain(hits: list[tuple[int, int, list[int], list[int]]], width: int) -> tuple[int, int]:
    """(distinct item windows, first place) of the best chain of (at, item_at, slots, item_slots): windows of which each follows the
    last within 4 widths, at most a width off its diagonal, and whose slots all map one to one."""
    chains: list[list] = []  # last at, last item_at, first at, item windows, map, map back
    done = [(0, 0)]
    for at, item_at, slots, item_slots in sorted(hits):
        keep, home = [], None
        for c in chains:
            if at - c[0] > 4 * width:
                done.append((len(c[3]), -c[2]))
                continue
            keep.append(c)
            near = item_at >= c[1] and item_at - c[1] <= 4 * width and abs((at - item_at) - (c[0] - c[1])) <= width
            if near and (home is None or (len(c[3]), -c[2]) > (len(home[3]), -home[2])) and all(c[4].get(x, y) == y and c[5].get(y, x) == x for x, y in zip(slots, item_slots, strict=False)):
                home = c
        chains = keep
        if home is None:
            home = [at, item_at, at, set(), {}, {}]
            chains.append(home)
        home[0], home[1] = at, item_at
        home[3].add(item_at)
        home[4].update(zip(slots, item_slots, strict=False))
        home[5].update(zip(item_slots, slots, strict=False))
    n, at = max(done + [(len(c[3]), -c[2]) for c in chains])
    return n, -at


def chained(hit: DataFrame, width: int) -> DataFrame:
    """_key, item, n_windows, at of the best chain of each pair."""
    each = hit.groupBy("_key", "item").agg(F.collect_set(F.struct("at", "item_at", "slots", "item_slots")).alias("hits"))  # as many as both texts allow
    kinds = {f.name: f.dataType.simpleString() for f in each.schema}

    def run(batches):
        for b in batches:
            found = [best_chain([(h["at"], h["item_at"], h["slots"], h["item_slots"]) for h in hits.as_py()], width) for hits in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["_key", "item", "n_windows", "at"])

    return each.mapInArrow(run, f"_key {kinds['_key']}, item {kinds['item']}, n_windows long, at long")


def decontamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
                    width: int = WIDTH, least: int = LEAST, share: float = 0.3, most: int = 1 << 20) -> DataFrame:
    """key, item, n_windows (of the item, found in the document), n_item_windows, at (token in the document) of contaminated pairs."""
    few = benchmark.select(F.col(item).alias("_item"), F.col(item_text).alias("_text"))
    docs = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key")).alias("_key"), F.col(text).alias("_text"))
    short = token_counts(few, "_item", "_text").where((F.col("n") >= least) & (F.col("n") < width)).select(F.col("n")).distinct()
    widths = sorted(r["n"] for r in short.collect()) + [width]  # width - least numbers at most
    own = token_counts(few, "_item", "_text").select("_key", "form", F.least("n", F.lit(width)).alias("_width"))
    asked = []
    for w in widths:
        for form in (0, 1, 2):
            of = few.join(own.where((F.col("_width") == w) & (F.col("form") == form)), few["_item"].eqNullSafe(F.col("_key")), "left_semi")
            asked.append(window_rows(of, "_item", "_text", [w], forms=(form,)))
    asked = settled(_union(asked).select(F.col("_key").alias("item"), F.col("at").alias("item_at"), F.col("hash").alias("_hash"), F.col("slots").alias("item_slots"), F.col("plain").alias("item_plain")).groupBy("item", "item_at", "_hash", "item_slots").agg(F.max("item_plain").alias("item_plain")), "benchmark-windows", rows=TEXTS)
    total = asked.groupBy("item").agg(F.countDistinct("item_at").alias("_all"), F.countDistinct(F.when(F.col("item_plain"), F.col("item_at"))).alias("_plain"))
    total = total.select("item", F.when(F.col("_plain") > 0, F.col("_plain")).otherwise(F.col("_all")).alias("n_item_windows"))
    hashes = asked.select("_hash").distinct()
    small = hashes.limit(most + 1).count() <= most
    wanted = np.unique(np.array([r["_hash"] for r in hashes.collect()], dtype=np.int64).view(np.uint64)) if small else None
    found = settled(window_rows(docs, "_key", "_text", widths, wanted), "document-windows", rows=TEXTS)
    side = F.broadcast(asked) if small and asked.count() <= most else asked
    pair = F.arrays_zip(F.col("slots").alias("a"), F.col("item_slots").alias("b"))
    one = lambda p: (F.size(F.array_distinct(F.transform(p, lambda x: x["a"]))) == F.size(F.array_distinct(p))) & (F.size(F.array_distinct(F.transform(p, lambda x: x["b"]))) == F.size(F.array_distinct(p)))
    hit = found.join(side, found["hash"] == side["_hash"]).withColumn("pair", pair).where(one(F.col("pair")))
    runs = (hit.where("plain and item_plain").groupBy("_key", "item", (F.col("at") - F.col("item_at")).alias("diagonal"))
            .agg(F.countDistinct("item_at").alias("n_windows"), F.min("at").alias("at"), F.flatten(F.collect_set("pair")).alias("pairs"))
            .where(one(F.col("pairs"))))
    both = runs.select("_key", "item", "n_windows", "at").union(chained(hit, width).select("_key", "item", "n_windows", "at"))
    best = both.groupBy(F.col("_key.key").alias("_key"), "item").agg(F.max(F.struct("n_windows", (-F.col("at")).alias("at"))).alias("best"))
    judged = best.join(total.withColumnRenamed("item", "_item"), F.col("item").eqNullSafe(F.col("_item")))
    return (judged.where(F.col("best.n_windows") >= share * F.col("n_item_windows"))
            .select(F.col("_key").alias(key), F.col("item").alias(item), F.col("best.n_windows").alias("n_windows"), "n_item_windows", (-F.col("best.at")).alias("at")))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
