r"""Substring dedup: near-duplicate passages by compact windows.

A text's tokens are its word shingles (five words, A-Z lowered), a passage ``least`` words or more, t shingles. For each of
``hashes`` min-hash functions, the Cartesian tree over the hashed shingles has a node for every stretch (l, c, r): all
subsequences within l..r that hold c have the hash of c as their minimum. Only nodes of t shingles or more matter; their
roots c are the minima of the sliding stretches of t, and l..r is the union of the stretches with that minimum, so
these nodes of the tree are found by a sliding minimum, about 2 n / t of them.

1. Compact windows whose minimum occurs in other documents go on.
2. Windows with the same minimum and the same shingles all along are one class; its members are linked to one of them.
3. Different classes of a minimum: in groups of up to ``crowd`` classes all pairs are formed whose windows overlap in t
   shingles around c. A pair of passages goes on where windows of two hash functions or more (``enough``) overlap on
   about the same diagonal (an interval join). The union of its windows on a diagonal is then verified on the texts: linked are all
   runs in which some stretch of t shingles has a Jaccard similarity of ``similar`` or more.
4. In larger groups (a line that thousands of documents share with little around it, or thousands of near copies) nothing is left
   to chance. The windows of a document unite to areas, and all pairs of similar stretches of t shingles of the areas are found by prefix
   filtering: ordered by how often a shingle occurs in all areas, rarest first, two similar stretches have one of their first few in
   common (``prefix``), as neither has more shingles that the other lacks. Places with a shingle in common that is among the first of a
   stretch in both meet: all pairs of ``crowd`` places or fewer; of more each meets that of the first row.
5. What step 4 leaves out, pairs of two places of more than ``crowd`` that aren't the first, matters only between passages that
   aren't of one class by then. After the classes are known, all these pairs are formed between different classes (or
   places outside any passage), in blocks, and verified, and the classes are worked out again; where that would be many pairs, each place first
   meets a few drawn ones, which joins most of what is alike. So each passage is with all its like; between
   passages of one class that are more than ``crowd`` around a shingle, it is as long as its links to the first and to others tell.

Passages of a document that overlap are merged, and passages linked to each other form a class.

Edge cases: null and empty texts, and texts below ``least`` words, have no passages; a passage repeated only within its own
row isn't reported; rows with equal or null ids are documents of their own; an empty table gives an empty result; further
columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismview.llm.common import TEXTS, components, forget, settled, table

SHINGLE, LEAST, HASHES, ENOUGH, SIMILAR, CROWD = 5, 50, 4, 2, 0.8, 8
NEAR = 4
#: Places of a block, where all pairs of many places are formed.
BLOCK = 256
#: Stretches that are asked of the texts, up to which they are sent to where the texts are.
FEW = 1 << 16
#: Turns in which places meet drawn ones, before all pairs are formed.
TURNS = 3
BASE = 0x9E3779B97F4A7C15
u64 = np.uint64


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ u64(seed)) * u64(0xFF51AFD7ED558CCD)
        x ^= x >> u64(32)
        x = x * u64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> u64(29))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: For bytes.translate: 1 for a byte that parts words.
PARTS = bytes(b in b" \t\n\x0b\x0c\r" for b in range(256))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** 0..n and its inverses modulo 2 ** 64; kept, and made anew when longer ones are needed."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = 1 << (n + 1).bit_length()
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, x, dtype=u64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=u64))
        _powers[base] = both[0], both[1]
    return _powers[base]


class Stretches:
    """Hashes of stretches of a sequence that don't depend on where they stand."""

    def __init__(self, s: np.ndarray, base: int = BASE | 1):
        power, self.back = powers(base, len(s))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, u64), np.cumsum(s * power[:len(s)], dtype=u64)])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[last + 1] - self.sums[first]) * self.back[first], 11) + (last - first).astype(u64)


def shingles(texts: list[str | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place within the row, hash) of all shingles of the texts; words are hashed as stretches of bytes."""
    raw = [(t or "").encode() for t in texts]
    data = b"\n".join([b"", *raw, b""]).lower()
    begins = np.cumsum([1, *[len(r) + 1 for r in raw]])
    part = np.frombuffer(data.translate(PARTS), dtype=bool)
    turns = np.flatnonzero(part[1:] != part[:-1])
    first, last = turns[0::2] + 1, turns[1::2]
    row = np.searchsorted(begins, first, side="right") - 1
    value = Stretches(np.frombuffer(data, dtype=np.uint8), 0xD6E8FEB86659FD93)(first, last)
    counts = np.bincount(row, minlength=len(raw))
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    n = max(0, len(row) - width + 1)
    s = np.zeros(n, dtype=u64)
    with np.errstate(over="ignore"):
        for k in range(width):
            s = (s + value[k:k + n]) * u64(BASE)
    whole = row[:n] == row[width - 1:] if n else np.zeros(0, dtype=bool)
    return row[:n][whole], place[:n][whole], mixed(s[whole], 7)


def function_seed(fn: int) -> int:
    return 0x51ED270B * (fn + 1)


def sliding_minimum(v: np.ndarray, width: int) -> np.ndarray:
    m, have = v, 1
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[:len(m) - step], m[step:])
        have += step
    return m


def compact_windows(row: np.ndarray, s: np.ndarray, t: int, seed: int) -> tuple[np.ndarray, ...]:
    """(c, l, r, hash of c) of the Cartesian tree's nodes of t shingles or more, as places in s; rows lie one after the other."""
    n = len(s) - t + 1
    none = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return none, none, none, np.zeros(0, u64)
    v, low = mixed(s, seed), u64((1 << 20) - 1)
    place = np.arange(len(s), dtype=u64)
    m = sliding_minimum((v & ~low) | (place & low), t)
    at = np.flatnonzero(row[:n] == row[t - 1:])
    if not len(at):
        return none, none, none, np.zeros(0, u64)
    m = m[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(at)) - 1
    left = at[starts]
    c = left + ((m[starts] & low).astype(np.int64) - left) % (1 << 20)
    return c, left, at[ends] + t - 1, v[c]


def minima(numbered: DataFrame, t: int, hashes: int) -> DataFrame:
    """h, row: the minima of the compact windows of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, _, s = shingles(b.column(1).to_pylist())
            ids = b.column(0).to_numpy()
            for fn in range(hashes):
                c, _, _, h = compact_windows(row, s, t, function_seed(fn))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[row[c]])], ["h", "row"])

    return numbered.select("_row", "_text", "_key").mapInArrow(run, "h long, row long")


def all_windows(numbered: DataFrame, t: int, hashes: int) -> DataFrame:
    """h, fn, row, c, l, r, whole: the compact windows of all texts; whole is the hash of all shingles l..r."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, place, s = shingles(b.column(1).to_pylist())
            ids, stretch = b.column(0).to_numpy(), Stretches(s)
            for fn in range(hashes):
                c, left, right, h = compact_windows(row, s, t, function_seed(fn))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(c), fn, np.int8)), pa.array(ids[row[c]]), *[pa.array(place[x].astype(np.int32)) for x in (c, left, right)], pa.array(stretch(left, right).view(np.int64))], ["h", "fn", "row", "c", "l", "r", "whole"])

    return numbered.select("_row", "_text", "_key").mapInArrow(run, "h long, fn byte, row long, c int, l int, r int, whole long")


def with_texts(numbered: DataFrame, asked: DataFrame, few: bool = False) -> DataFrame:
    """row, text, the different ones of what is asked (row, lo, hi, c) of it, key. few: they are FEW at most, so the texts stay where they are."""
    lists = asked.groupBy("row").agg(F.collect_set(F.struct("lo", "hi", "c")).alias("asked"))  # as many as the text is long at most
    return lists.hint("broadcast" if few else "shuffle_hash").join(numbered, lists["row"] == numbered["_row"]).select("row", "_text", "asked", "_key")


def _wanted(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of a batch of with_texts: all shingles; for each that is asked its row, the text's first shingle and the end, lo, hi and c."""
    row, _, s = shingles(b.column(1).to_pylist())
    first, wants = np.searchsorted(row, np.arange(b.num_rows + 1)), b.column(2)
    doc = np.repeat(np.arange(b.num_rows), np.diff(wants.offsets.to_numpy()))
    lo, hi, c = (wants.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("lo", "hi", "c"))
    return s, b.column(0).to_numpy()[doc], first[doc], np.minimum(first[doc + 1], first[doc] + hi + 1), lo, hi, c


def asked_stretches(numbered: DataFrame, asked: DataFrame, few: bool = False) -> DataFrame:
    """row, lo, hi, shingles of the asked (row, lo, hi). few: as in ``with_texts``."""
    def run(batches):
        for b in batches:
            s, ids, at, end, lo, hi, _ = _wanted(b)
            for k in range(0, len(ids), 2048):
                w = slice(k, k + 2048)
                start, length = at[w] + lo[w], np.maximum(end[w] - at[w] - lo[w], 0)
                offsets = np.concatenate([[0], np.cumsum(length)])
                flat = s[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(ids[w], pa.int64()), pa.array(lo[w].astype(np.int32)), pa.array(hi[w].astype(np.int32)), lists], ["row", "lo", "hi", "shingles"])

    held = with_texts(numbered, asked.withColumn("c", F.lit(0)), few)
    return settled(held.mapInArrow(run, "row long, lo int, hi int, shingles array<long>"), "asked-stretches", rows=TEXTS)


def areas(numbered: DataFrame, windows: DataFrame) -> DataFrame:
    """row, lo, hi, shingles: the unions of overlapping windows (row, l, r) of each row."""
    def run(batches):
        for b in batches:
            s, ids, at, end, lo, _, _ = _wanted(b)
            order = np.argsort(at + lo, kind="stable")
            at, ids, begin, reach = at[order], ids[order], (at + lo)[order], np.maximum.accumulate(end[order])
            new = np.ones(len(at), dtype=bool)
            new[1:] = (begin[1:] >= reach[:-1]) | (at[1:] != at[:-1])
            first = np.flatnonzero(new)
            start, stop = begin[first], reach[np.append(first[1:], len(at)) - 1] if len(first) else first
            offsets = np.concatenate([[0], np.cumsum(stop - start)])
            flat = s[np.repeat(start - offsets[:-1], stop - start) + np.arange(offsets[-1])].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(ids[first], pa.int64()), *[pa.array((x - at[first]).astype(np.int32)) for x in (start, stop - 1)], lists], ["row", "lo", "hi", "shingles"])

    asked = windows.select("row", F.col("l").alias("lo"), F.col("r").alias("hi"), F.lit(0).alias("c"))
    return settled(with_texts(numbered, asked).mapInArrow(run, "row long, lo int, hi int, shingles array<long>"), "crowd-areas", rows=TEXTS)


def prefix(t: int, similar: float, n: int, other: int | None = None) -> int:
    """How many of the first of n different shingles must hold one that a similar stretch has: one more than the other may lack. other: how
    many different ones it has, if that is known."""
    lacks = n * (1 - similar) if other is None else n - similar / (1 + similar) * (n + other)
    return min(n, int(lacks + 1e-9) + 1)


def first_places(place: np.ndarray, key: np.ndarray, begin: np.ndarray, stop: np.ndarray, t: int, similar: float) -> np.ndarray:
    """Three flags for each place of areas begin..stop that lie one after the other: among the first of a stretch of t without repeats as
    such a one needs against others without repeats, and against any; of a stretch with repeats. key: the order of shingles."""
    n = len(key)
    order = np.lexsort((place, key, np.repeat(np.arange(len(begin)), stop - begin)))
    before = np.full(n, -1)  # the place before with the same shingle in the area
    again = (key[order][1:] == key[order][:-1]) & (np.repeat(np.arange(len(begin)), stop - begin)[order][1:] == np.repeat(np.arange(len(begin)), stop - begin)[order][:-1])
    before[order[1:][again]] = order[:-1][again]
    starts = np.flatnonzero(np.repeat(stop, stop - begin) - np.arange(n) >= t)
    few, any_, most = prefix(t, similar, t, t), prefix(t, similar, t), np.array([prefix(t, similar, k) for k in range(t + 1)])
    least = np.zeros((3, n + t), dtype=np.uint64)  # the largest key that counts, by where the stretch begins; t places behind
    for k in range(0, len(starts), 1 << 14):
        at = starts[k:k + (1 << 14)]
        where = at[:, None] + np.arange(t)
        v = key[where]
        twice = before[where] >= at[:, None]
        v[twice] = ~np.uint64(0)
        different = t - twice.sum(axis=1)
        v = np.sort(np.partition(v, any_ - 1, axis=1)[:, :any_], axis=1)
        whole = different == t
        least[0, at[whole] + t - 1] = v[whole, few - 1]
        least[1, at[whole] + t - 1] = v[whole, any_ - 1]
        least[2, at[~whole] + t - 1] = v[~whole, most[different[~whole]] - 1]
    # a place counts by any stretch that begins up to t - 1 before it; keys are 1 or more
    high = np.array([sliding_maximum(x, t)[:n] for x in least])
    return key[None] <= high


def sliding_maximum(v: np.ndarray, width: int) -> np.ndarray:
    return ~sliding_minimum(~v, width)


def area_places(found: DataFrame, t: int, similar: float) -> DataFrame:
    """key, flags (of ``first_places``, as 1, 2, 4), row, spot: the places that may meet. found: row, lo, hi, places (place, n, shingle), where
    other places are of shingles found once. spot: the place and how far it lies from its area's ends, t - 1 at most."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, lo, hi = (b.column(k).to_numpy() for k in range(3))
            lists = b.column(3)
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            place, n, s = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("place", "n", "shingle"))
            stop = np.cumsum(hi - lo + 1)
            begin = stop - (hi - lo + 1)
            at = begin[row] + place - lo[row]
            key = np.arange(1, stop[-1] + 1, dtype=np.uint64)  # shingles found once come first
            key[at] = (np.minimum(n, (1 << 20) - 1).astype(np.uint64) << u64(44)) | (mixed(s.view(np.uint64), 41) >> u64(20))
            flags = first_places(np.arange(len(key)), key, begin, stop, t, similar)
            left, right = np.minimum(at - begin[row], t - 1), np.minimum(stop[row] - 1 - at, t - 1)
            spot = (place.astype(np.int64) << 32) | (left << 16) | right
            flags = (flags[:, at] * np.array([[1], [2], [4]])).sum(axis=0).astype(np.int8)
            some = np.flatnonzero(flags)
            yield pa.RecordBatch.from_arrays([pa.array(s[some]), pa.array(flags[some]), pa.array(ids[row[some]], pa.int64()), pa.array(spot[some])], ["key", "flags", "row", "spot"])

    return found.mapInArrow(run, "key long, flags byte, row long, spot long")


def crowd_places(numbered: DataFrame, crowd_rows: DataFrame, t: int, similar: float) -> DataFrame:
    """area_places of the crowded windows."""
    held = areas(numbered, crowd_rows)
    counts = settled(held.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("shingle", "_s"), "crowd-counts")
    each = held.select("row", "lo", "hi", F.posexplode("shingles").alias("k", "shingle"))
    found = (each.join(counts.hint("shuffle_hash"), each["shingle"] == counts["_s"])
             .groupBy("row", "lo", "hi").agg(F.collect_list(F.struct((F.col("lo") + F.col("k")).alias("place"), F.col("n"), F.col("shingle"))).alias("places")))  # as long as the text at most
    return settled(area_places(found, t, similar), "crowd-places", held, counts, rows=TEXTS)


def _meeting() -> list[Column]:
    """a, b, d, lo, hi of two places (row, spot) and (_row, _spot), the smaller row first."""
    turned = F.col("row") > F.col("_row")
    one, two = (lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x)) for _ in range(2))
    reach = lambda bits: F.greatest(*[F.shiftright(c, bits).bitwiseAND(F.lit(0xFFFF)) for c in ("spot", "_spot")])
    at, other = F.shiftright(one("spot", "_spot"), 32), F.shiftright(two("_spot", "spot"), 32)
    return [one("row", "_row").alias("a"), two("_row", "row").alias("b"), (at - other).cast("int").alias("d"), at.cast("int").alias("at"),
            (at - reach(16)).cast("int").alias("lo"), (at + reach(0)).cast("int").alias("hi")]


def _met(places: DataFrame, t: int) -> DataFrame:
    """a, b, d, lo, hi: meetings of places on a diagonal in a cell of t are one."""
    return places.select(*_meeting()).groupBy("a", "b", "d", F.floor(F.col("at") / t).alias("cell")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("a", "b", "d", "lo", "hi")


def crowd_meetings(places: DataFrame, t: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Meetings of the places with a key in common, and (key, kind, main, row, spot) of the places of keys that more than ``crowd`` have, of which
    each met the first only. kind 0: stretches without repeats on both sides; kind 1: one of the two (a ``main`` one) has some."""
    whole, every, main = (F.col("flags").bitwiseAND(F.lit(k).cast("byte")) != 0 for k in (1, 6, 4))
    sides = {"0": F.when(whole, F.col("row")), "1": F.when(every, F.col("row") + F.when(main, 0).otherwise(1 << 62))}  # a main place comes first
    sizes = places.groupBy("key").agg(F.bool_or(main).alias("m1"), *[f for k, x in sides.items() for f in (
        F.count(x).alias(f"n{k}"), F.min(F.when(x.isNotNull(), F.col("row"))).alias(f"x{k}"), F.max(F.when(x.isNotNull(), F.col("row"))).alias(f"y{k}"), F.min_by("row", x).alias(f"r{k}"), F.min_by("spot", x).alias(f"s{k}"))])
    sizes = sizes.where("x0 < y0 or x1 < y1 and m1").withColumnRenamed("key", "_key").hint("shuffle_hash")
    joined = settled(places.join(sizes, places["key"] == F.col("_key")).where((whole & (F.col("x0") < F.col("y0"))) | (every & F.col("m1") & (F.col("x1") < F.col("y1")))).drop("_key"), "crowd-members", places)
    kinds = [joined.where(x).select("key", F.lit(int(k)).alias("kind"), (F.lit(True) if k == "0" else main).alias("main"), "row", "spot", F.col(f"n{k}").alias("n"), F.col(f"r{k}").alias("_row"), F.col(f"s{k}").alias("_spot"))
             for k, x in (("0", whole & (F.col("x0") < F.col("y0"))), ("1", every & F.col("m1") & (F.col("x1") < F.col("y1"))))]
    held = kinds[0].union(kinds[1])
    few, many = (held.where(x) for x in (F.col("n") <= crowd, F.col("n") > crowd))
    few = few.drop("_row", "_spot")
    pairs = few.join(few.select(F.col("key").alias("_key"), F.col("kind").alias("_kind"), F.col("main").alias("_main"), F.col("row").alias("_row"), F.col("spot").alias("_spot")),
                     (F.col("key") == F.col("_key")) & (F.col("kind") == F.col("_kind")) & (F.col("row") < F.col("_row")) & (F.col("main") | F.col("_main")))
    each = ["row", "spot", "_row", "_spot"]
    out = settled(_met(pairs.select(each).union(many.where("row <> _row").select(each)), t), "crowd-pairs")
    return out, settled(held.where(F.col("n") > crowd).select("key", "kind", "main", "row", "spot"), "crowd-many", joined)


def left_out(members: DataFrame, islands: DataFrame, t: int, turn: int) -> tuple[DataFrame, bool]:
    """a, b, d, lo, hi: meetings that ``crowd_meetings`` left out, between places that aren't in passages of one class; and whether these are
    all. They are all pairs, formed in blocks of about ``BLOCK`` places; while these are many, in the first ``TURNS`` turns each place meets two
    drawn ones of its key, so that what is alike is mostly of one class before all other pairs are formed."""
    found = islands.select(F.col("row").alias("_r"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "component")
    at = F.shiftright("spot", 32)
    many = members.join(found, (members["row"] == found["_r"]) & at.between(F.col("_lo"), F.col("_hi")), "left").select("key", "kind", "main", "row", "spot", F.coalesce("component", F.xxhash64("row", "spot")).alias("class"))
    many = settled(many, "crowd-classes")
    mixed = many.groupBy("key", "kind", "class").agg(F.count("*").alias("n"), *[f for k in (0, 1) for f in (F.min(F.xxhash64("row", F.lit(turn), F.lit(k))).alias(f"h{k}"), F.min_by("row", F.xxhash64("row", F.lit(turn), F.lit(k))).alias(f"r{k}"), F.min_by("spot", F.xxhash64("row", F.lit(turn), F.lit(k))).alias(f"s{k}"))])
    mixed = mixed.groupBy(F.col("key").alias("_key"), F.col("kind").alias("_kind")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q"), F.count("*").alias("classes"), *[F.min_by(f"{c}{k}", f"h{k}").alias(f"{c}{k}") for k in (0, 1) for c in ("r", "s")],
        *[F.min_by("class", f"h{k}").alias(f"c{k}") for k in (0, 1)]).where("classes > 1")
    mixed = settled(mixed.withColumn("blocks", F.ceil(F.col("n") / BLOCK)), "crowd-mixed-keys")
    places, pairs = mixed.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("q")) / 2)).first()
    drawn = turn < TURNS and (pairs or 0) > CROWD * (places or 0)
    mixed = mixed.drop("n", "q", "classes").hint("shuffle_hash")
    held = settled(many.join(mixed, (many["key"] == F.col("_key")) & (many["kind"] == F.col("_kind"))).drop("_key", "_kind"), "crowd-mixed", many)
    if drawn:
        each = [held.where((F.col("class") != F.col(f"c{k}")) & (F.col("row") != F.col(f"r{k}"))).select("row", "spot", F.col(f"r{k}").alias("_row"), F.col(f"s{k}").alias("_spot")) for k in (0, 1)]
        return settled(_met(each[0].union(each[1]), t), "crowd-drawn", held), False
    mine, every = F.pmod(F.xxhash64("spot", "row"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    held_ = held.select("key", "kind", "main", "row", "spot", "class", "blocks")
    one = held_.withColumn("i", mine).withColumn("j", every)
    two = held_.withColumn("_j", mine).withColumn("_i", every).select("_i", "_j", *[F.col(c).alias(f"_{c}") for c in ("key", "kind", "main", "row", "spot", "class")])
    same = [F.col(c) == F.col(f"_{c}") for c in ("key", "kind", "i", "j")]
    pairs = one.join(two, same[0] & same[1] & same[2] & same[3] & (F.col("row") < F.col("_row")) & (F.col("class") != F.col("_class")) & (F.col("main") | F.col("_main")))
    return settled(_met(pairs, t), "crowd-left-out", held), True


def _first_match(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray) -> np.ndarray:
    """For each shingle of a the first place in b of an equal one of the same pair, or -1."""
    if not len(b):
        return np.full(len(a), -1)
    with np.errstate(over="ignore"):
        keys = [mixed(x.view(u64) ^ (of.astype(u64) * u64(BASE)), 53) for x, of in ((a, of_a), (b, of_b))]
    order = np.argsort(keys[1], kind="stable")
    at = order[np.minimum(np.searchsorted(keys[1][order], keys[0]), len(b) - 1)]
    return np.where((b[at] == a) & (of_b[at] == of_a), at, -1)


def _different(v: np.ndarray) -> np.ndarray:
    """How many different values each line of v has."""
    v = np.sort(v, axis=1)
    return 1 + (v[:, 1:] != v[:, :-1]).sum(axis=1)


def _best_stretches(a: np.ndarray, b: np.ndarray, match: np.ndarray, at: np.ndarray, begin: np.ndarray, last: np.ndarray, t: int, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the stretches of a that begin at ``at``: the largest Jaccard similarity with a stretch of b (begin..last of their first shingles)
    that begins where a match suggests, and where that is; 0 where fewer match than ``similar`` needs."""
    best, where = np.zeros(len(at)), np.zeros(len(at), dtype=np.int64)
    found = match[at[:, None] + np.arange(t)]
    x = a[at[:, None] + np.arange(t)]
    size = _different(x)
    some = np.flatnonzero((found >= 0).sum(axis=1) >= similar * size - 1e-9)
    j = np.where(found[some] >= 0, np.clip(found[some] - np.arange(t), begin[some, None], last[some, None]), -1)
    j.sort(axis=1)
    new = j >= 0
    new[:, 1:] &= j[:, 1:] != j[:, :-1]
    line, column = np.nonzero(new)
    of, start = some[line], j[line, column]
    y = b[start[:, None] + np.arange(t)]
    either = _different(np.concatenate([x[of], y], axis=1))
    both = size[of] + _different(y) - either
    order = np.lexsort((start, both / either, of))
    top = order[np.append(of[order][1:] != of[order][:-1], True)] if len(of) else order
    best[of[top]], where[of[top]] = (both / either)[top], start[top]
    return best, where


def similar_stretches_of(xs: np.ndarray, xo: np.ndarray, ys: np.ndarray, yo: np.ndarray, t: int, similar: float) -> tuple[np.ndarray, ...]:
    """pair, first and last place in a, first and last in b, for the pairs of a = xs[xo[n]:xo[n + 1]] and b = ys[yo[n]:yo[n + 1]]: all runs of
    stretches of t shingles of a that match b, in which some stretch and one of b's, starting where a's matches suggest, have a Jaccard
    similarity of ``similar`` or more."""
    long = (np.diff(xo) >= t) & (np.diff(yo) >= t)
    of_a, of_b = np.repeat(np.arange(len(xo) - 1), np.diff(xo)), np.repeat(np.arange(len(yo) - 1), np.diff(yo))
    match = _first_match(xs, of_a, ys, of_b)
    hits = np.concatenate([[0], np.cumsum(match >= 0)])
    starts = np.flatnonzero((xo[of_a + 1] - np.arange(len(xs)) >= t) & long[of_a])
    none = np.zeros(0, dtype=np.int64)
    if not len(starts):
        return (none,) * 5
    near, pair = hits[starts + t] - hits[starts], of_a[starts]
    heads = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    most = np.repeat(np.maximum.reduceat(near, heads), np.diff(np.append(heads, len(pair))))
    # with repeated shingles a stretch may be similar below the usual number of matches, so the best one is always tried
    high = np.flatnonzero(near >= np.minimum(most, 2 * similar / (1 + similar) * t))
    new = np.append(True, (np.diff(high) > 1) | (pair[high][1:] != pair[high][:-1]))
    run = np.cumsum(new) - 1
    first, last = starts[high[new]], starts[high[np.append(new[1:], True)]]
    # the stretches of a run, most matches first; every round tries the next one of each run that has none yet
    order = np.lexsort((high, -near[high], run))
    begins, sizes = np.flatnonzero(new), np.bincount(run)
    open_, k, out = np.arange(len(first)), 0, []
    while len(open_):
        at = starts[high[order[begins[open_] + k]]]
        p = of_a[at]
        best, j = _best_stretches(xs, ys, match, at, yo[p], yo[p + 1] - t, t, similar)
        good = best >= similar
        r, i, j, p = open_[good], at[good], j[good], p[good]
        out.append((r, p, first[r] - xo[p], last[r] + t - 1 - xo[p], np.maximum(0, j - yo[p] - (i - first[r])), np.minimum(yo[p + 1] - yo[p] - 1, j - yo[p] + (last[r] - i) + t - 1)))
        k += 1
        open_ = open_[~good]
        open_ = open_[sizes[open_] > k]
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    order = np.argsort(columns[0], kind="stable")
    return tuple(c[order] for c in columns[1:])


def similar_stretches(a: np.ndarray, b: np.ndarray, t: int, similar: float) -> list[tuple[int, int, int, int]]:
    """``similar_stretches_of`` one pair: (first and last place in a, first and last in b)."""
    got = similar_stretches_of(a, np.array([0, len(a)]), b, np.array([0, len(b)]), t, similar)
    return list(zip(*(c.tolist() for c in got[1:]), strict=True))


def verified(pairs: DataFrame, sketch: DataFrame, t: int, similar: float) -> DataFrame:
    """a, a_lo, a_hi, b, b_lo, b_hi of the pairs' stretches that are similar enough."""
    one = sketch.select(F.col("row").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.col("shingles").alias("x"))
    two = sketch.select(F.col("row").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), F.col("shingles").alias("y"))
    both = pairs.join(one, ["a", "a_lo", "a_hi"]).join(two, ["b", "b_lo", "b_hi"]).select("a", "a_lo", "b", "b_lo", "x", "y")

    def run(batches):
        for b in batches:
            x, y = b.column(4), b.column(5)
            xs, ys = x.flatten().to_numpy(), y.flatten().to_numpy()
            xo, yo = x.offsets.to_numpy() - x.offsets[0].as_py(), y.offsets.to_numpy() - y.offsets[0].as_py()
            ids = [b.column(i).to_numpy() for i in range(4)]
            for n in range(0, b.num_rows, 512):
                end = min(n + 512, b.num_rows)
                p, *at = similar_stretches_of(xs[xo[n]:xo[end]], xo[n:end + 1] - xo[n], ys[yo[n]:yo[end]], yo[n:end + 1] - yo[n], t, similar)
                one, one_lo, two, two_lo = (c[n:end][p] for c in ids)
                kinds = [pa.int64(), pa.int32(), pa.int32()] * 2
                columns = [one, one_lo + at[0], one_lo + at[1], two, two_lo + at[2], two_lo + at[3]]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], ["a", "a_lo", "a_hi", "b", "b_lo", "b_hi"])

    return both.mapInArrow(run, "a long, a_lo int, a_hi int, b long, b_lo int, b_hi int")


def _pieces(agreed: DataFrame, t: int) -> DataFrame:
    """The union of the meetings of two rows on one diagonal, as a, b, d, lo, hi: pieces of 16 t shingles that overlap by so much
    that each stretch of t lies in one with NEAR shingles to spare."""
    order = Window.partitionBy("a", "b", "d").orderBy("lo", "hi")  # a text has as many meetings on a diagonal as it is long
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = agreed.withColumn("new", F.when(F.col("lo") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    islands = marked.groupBy("a", "b", "d", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    starts = F.sequence("lo", F.greatest(F.col("lo"), F.col("hi") - t - 2 * NEAR), F.lit(16 * t))
    cut = islands.withColumn("start", F.explode(starts))
    return cut.select("a", "b", "d", F.col("start").alias("lo"), F.least(F.col("hi"), F.col("start") + 17 * t + 2 * NEAR).alias("hi"))


def passage_links(numbered: DataFrame, least: int = LEAST, hashes: int = HASHES, enough: int = ENOUGH, similar: float = SIMILAR, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """a, a_lo, a_hi, b, b_lo, b_hi: linked stretches of shingles of rows a and b; and the members of ``crowd_meetings``."""
    t = least - SHINGLE + 1
    # windows are made twice, since a table of all of them would take more disk than the texts; the first time it is only the minima
    shared = minima(numbered, t, hashes).groupBy("h").agg(F.min("row").alias("x"), F.max("row").alias("y")).where("x < y").select("h")
    shared = settled(shared, "shared-minima", rows=TEXTS)
    held = settled(all_windows(numbered, t, hashes).join(shared.hint("shuffle_hash"), "h", "left_semi"), "shared-windows", shared, rows=TEXTS)
    # the window with the least hash of its place stands for a class, so no row leads many; within a class c and r lie at the
    # same distance from l. All buffers are numbers, so that this is a hash aggregate
    drawn = F.xxhash64("row", "l")
    classes = held.groupBy("h", "fn", "whole").agg(
        F.min_by("row", drawn).alias("row"), F.min_by("l", drawn).alias("l"), F.min(F.col("c") - F.col("l")).alias("_c"), F.min(F.col("r") - F.col("l")).alias("_r"), (F.max("row") > F.min("row")).alias("several"))
    classes = settled(classes.select("h", "fn", "whole", "row", (F.col("l") + F.col("_c")).alias("c"), "l", (F.col("l") + F.col("_r")).alias("r"), "several"), "window-classes")

    many = classes.where("several").select(F.col("h").alias("_h"), F.col("whole").alias("_whole"), F.col("row").alias("b"), F.col("l").alias("b_lo"), F.col("r").alias("b_hi")).hint("shuffle_hash")
    same = (held.join(many, (held["h"] == many["_h"]) & (held["whole"] == many["_whole"])).where("row <> b or l <> b_lo")
            .select(F.col("row").alias("a"), F.col("l").alias("a_lo"), F.col("r").alias("a_hi"), "b", "b_lo", "b_hi"))
    same = settled(_diagonals(same, least), "same-windows", held)

    sizes = settled(classes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "group-sizes")
    split = settled(classes.join(sizes.hint("shuffle_hash"), "h").select("h", "fn", "row", "c", "l", "r", "n"), "groups", classes, sizes)
    some, crowd_rows = split.where(F.col("n") <= crowd), split.where(F.col("n") > crowd)
    x = some.select("h", "fn", F.col("row").alias("a"), F.col("c").alias("ca"), F.col("l").alias("la"), F.col("r").alias("ra"))
    y = some.select(F.col("h").alias("_h"), F.col("row").alias("b"), F.col("c").alias("cb"), F.col("l").alias("lb"), F.col("r").alias("rb"))
    left, right = F.least(F.col("ca") - F.col("la"), F.col("cb") - F.col("lb")), F.least(F.col("ra") - F.col("ca"), F.col("rb") - F.col("cb"))
    aligned = lambda p, q: p.join(q, (p["h"] == q["_h"]) & (F.col("a") < F.col("b")) & (left + right + 1 >= t - NEAR))
    place = ["a", "b", (F.col("ca") - F.col("cb")).alias("d"), (F.col("ca") - left).alias("lo"), (F.col("ca") + right).alias("hi")]
    met = settled(aligned(x, y).select("fn", "ca", *place), "window-pairs")
    # enough hash functions agree: each meeting counts the functions whose meetings overlap it on about the same diagonal
    other = met.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("fn").alias("fn2"), F.col("d").alias("d2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    overlap = F.least("hi", "hi2") - F.greatest("lo", "lo2") >= t // 2
    agreed = (met.join(other, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")) & (F.abs(F.col("d") - F.col("d2")) <= NEAR) & overlap)
              .groupBy("a", "b", "fn", "ca", "d", "lo", "hi").agg(F.countDistinct("fn2").alias("n"))
              .where(F.col("n") >= enough))
    agreed = settled(agreed.select("a", "b", "d", "lo", "hi").distinct(), "agreed-pairs", met)

    crowds, members = crowd_meetings(crowd_places(numbered, crowd_rows, t, similar), t, crowd)
    near = verified_meetings(numbered, agreed.union(crowds), t, similar)
    forget(split, agreed, crowds)
    return settled(same.union(near), "passage-links", same, near), members


def verified_meetings(numbered: DataFrame, met: DataFrame, t: int, similar: float) -> DataFrame:
    """a, a_lo, a_hi, b, b_lo, b_hi: the similar stretches of the meetings a, b, d, lo, hi."""
    # both sides with some shingles to spare, for words put in or left out
    pairs = settled(_pieces(met, t).select("a", F.greatest(F.col("lo") - NEAR, F.lit(0)).alias("a_lo"), (F.col("hi") + NEAR).alias("a_hi"), "b",
                                           F.greatest(F.col("lo") - F.col("d") - NEAR, F.lit(0)).alias("b_lo"), (F.col("hi") - F.col("d") + NEAR).alias("b_hi")), "passage-pairs")
    asked = pairs.select(F.col("a").alias("row"), F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi")).union(pairs.select("b", "b_lo", "b_hi"))
    sketch = asked_stretches(numbered, asked, 2 * pairs.count() <= FEW)
    return settled(verified(pairs, sketch, t, similar), "near-stretches", pairs, sketch)


def _diagonals(links: DataFrame, least: int) -> DataFrame:
    """Equal stretches of two rows on one diagonal whose starts lie less than their least length apart overlap or touch: one link."""
    span = least - SHINGLE + 1
    return (links.groupBy("a", "b", (F.col("a_lo") - F.col("b_lo")).alias("d"), F.floor(F.col("a_lo") / span).alias("cell"))
            .agg(F.min("a_lo").alias("a_lo"), F.max("a_hi").alias("a_hi"))
            .select("a", "a_lo", "a_hi", "b", (F.col("a_lo") - F.col("d")).alias("b_lo"), (F.col("a_hi") - F.col("d")).alias("b_hi")))


def numbered_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_row, _key, _text, where a row has the same number at each reading of all three columns.

    Files give their rows in the same order each time, and so does a repartition of the same columns; another plan may not (a sort by
    random numbers, say). So the numbered rows are summed up twice, and written only if the sums differ.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    sums = [numbered.agg(F.count("*"), F.bit_xor(F.xxhash64("_row", "_key", "_text"))).first() for _ in range(2)]
    return numbered if sums[0] == sums[1] else settled(numbered, "numbered")


def passages(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """row, lo, hi, component: stretches of a row that overlap are one passage, and linked ones are of one component. known: passages to which
    the links are added; only their components that new links or longer passages bring together are worked out again."""
    ends = links.select(F.col("a").alias("row"), F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi")).union(links.select("b", "b_lo", "b_hi")).distinct()
    ends = ends.withColumn("was", F.lit(None).cast("long"))
    if known is not None:
        ends = ends.union(known.select("row", "lo", "hi", "component"))
    # islands of overlapping stretches of a row; a row has as many stretches as its text allows
    order = Window.partitionBy("row").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.coalesce(F.col("lo") <= reach, F.lit(False)), None).otherwise(F.col("lo"))
    marked = ends.withColumn("begins", begins).withColumn("start", F.max("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # an island goes by a component that it had; one without is told by where it starts, where no passage known before can have started
    node = F.xxhash64("row", "start")
    if known is not None:
        node = F.coalesce(F.min("was").over(Window.partitionBy("row", "start")), node)
    spot = settled(marked.select("row", "lo", "hi", "was", "start", node.alias("node")), "passage-spots")
    new = spot.where("was is null")
    side = lambda p: new.select(F.col("row").alias(p), F.col("lo").alias(f"{p}_lo"), F.col("hi").alias(f"{p}_hi"), F.col("node").alias(f"{p}_node"))
    edges = links.join(side("a"), ["a", "a_lo", "a_hi"]).join(side("b"), ["b", "b_lo", "b_hi"]).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    label = components(edges.union(spot.where("was <> node").select("node", "was")), "passages")
    found = spot.groupBy("row", "start").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("node").alias("node"))
    found = found.join(label, "node", "inner" if known is None else "left")
    return settled(found.select("row", "lo", "hi", F.coalesce("component", "node").alias("component")), "islands", spot, label, *([] if known is None else [known]))


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, **options) -> DataFrame:
    """key, start_word, end_word (exclusive), class_id (smallest key with a passage of the class), n_passages (of the class) of
    every passage that is repeated in another row."""
    numbered = numbered_rows(docs, key, text)
    t, similar = least - SHINGLE + 1, options.get("similar", SIMILAR)
    links, members = passage_links(numbered, least, **options)
    islands, turn, all_ = passages(links), 0, False
    forget(links)
    while not all_:
        met, all_ = left_out(members, islands, t, turn)
        if met.limit(1).count():
            more = verified_meetings(numbered, met, t, similar)
            islands = passages(more, islands) if more.limit(1).count() else islands
            forget(more)
        forget(met)
        turn += 1
    forget(members)
    names = settled(numbered.select("_row", "_key", F.xxhash64("_text")), "names").select("_row", "_key")  # the text is read, see numbered_rows
    found = settled(islands.join(names, F.col("row") == F.col("_row")).select("component", "_key", "lo", "hi"), "passages")
    size = settled(found.groupBy("component").agg(F.min("_key").alias("class_id"), F.count("*").alias("n_passages")).withColumnRenamed("component", "_component"), "passage-classes")
    return (found.join(size, found["component"] == size["_component"])
            .select(F.col("_key").alias(key), F.col("lo").alias("start_word"), (F.col("hi") + SHINGLE).alias("end_word"), "class_id", "n_passages"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
