"""Best-fit packing in bulk-synchronous rounds.

Documents become pieces of at most ``capacity`` tokens. New sequences are opened, as many as the pieces left need at least;
each is a gap of ``capacity``. In a round the gaps and the pieces that are left are range-sorted together by falling size.
A task sweeps its range: a piece takes its successor, the smallest gap before it that is still free, which makes gaps and
pieces match like brackets. What a range can't match itself is numbered; gaps left over in a range go to the pieces left over
in later ones by rank, the nearest first, from a table with two numbers per range. Then all gaps are updated by their pieces'
lengths, and the next round follows, until no piece moves; then new sequences are opened, until no piece is left. While there
are more pieces than gaps, a gap offers places for several of the longest pieces left, as far as it surely holds them.

All tables are rows of pieces and gaps in the cluster; the driver sees the two numbers per range and a round's counts. About
ten rounds are usual; a round handles all pieces left at once.

Edge cases: a null or empty text is one piece that holds the end mark alone; null and repeated ids stay as they
are; rows repeated are packed as often as they come; an empty table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from prismview.llm.common import settled, table

CAPACITY = 2048
#: A range that a task sweeps has MANY rows at most, about, and no fewer than FEW.
FEW, MANY = 1 << 15, 1 << 20
_tokenizers: dict[str, object] = {}


class WordIds:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space, lowers letters and never looks across the pieces that it cuts a text into. A text of
    plain Latin letters, digits and signs is cut into the same pieces here, and a piece goes straight to the tokenizer's
    merges; of any other text the blank-separated parts are the pieces, and go through the whole tokenizer. Pieces are
    remembered, up to ``most`` of them, and then forgotten all at once.
    """

    #: The tokenizer's own splitting rule, for the characters that don't match OTHER, and its signs for bytes.
    PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^a-zÀ-ÖØ-öø-ÿ0-9 \n]+")
    OTHER = re.compile("[^!-~À-ÖØ-öø-ÿ \n]")
    UNLOWERED = re.compile("[^!-@\\[-~À-ÖØ-öø-ÿ]")
    SAMPLES = ("the", "x9", "élan", "straße", "...", "'s", "<|", "hyperbolic")

    def __init__(self, path: str, most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known: dict[str, bytes] = {"": b""}
        #: Names of special tokens, which stand for one id wherever they occur; lowered, to find what might be one.
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        rest = [b for b in range(256) if b not in shown]
        self.signs = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.merges = self.tokenizer.model.tokenize
        self.direct = all([self.merged(p) for p in self.PIECES.findall(t)] == self.encoded(self.PIECES.findall(t)) for t in self.SAMPLES)

    def encoded(self, new: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]

    def merged(self, piece: str) -> bytes:
        signs = piece if piece.isascii() else "".join(map(self.signs.__getitem__, piece.lower().encode()))
        return array("I", [t.id for t in self.merges(signs)]).tobytes()

    def learn(self, new: list[str]) -> None:
        other = [p for p in new if not self.direct or self.UNLOWERED.search(p) or any(x in p for x in self.special) or not self.whole(p)]
        self.known.update(zip(other, self.encoded(other), strict=True))
        rest = set(new).difference(other)
        self.known.update((p, self.merged(p)) for p in rest)

    def whole(self, part: str) -> bool:
        """Whether the tokenizer wouldn't cut a part any further."""
        m = self.PIECES.match(part)
        return m is not None and m.end() == len(part)

    def cut(self, text: str) -> list[str]:
        low = text.lower()
        if any(x in low for x in self.special):
            return text.replace("\n", " ").split(" ")
        text = text.encode().lower().decode()  # A-Z only
        return text.replace("\n", " ").split(" ") if self.OTHER.search(text) else self.PIECES.findall(text)

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut(t) for t in texts]
        if len(self.known) > self.most:
            self.known = {"": b""}
        self.learn(list(set().union(*cut) - self.known.keys()))
        known = self.known
        return [b"".join(map(known.__getitem__, c)) for c in cut]


def word_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 (and ids, the little-endian bytes, if asked for) of each document's ids and end mark."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(vocabulary)
        for b in batches:
            row, piece, start, length, crc, held = [], [], [], [], [], []
            for i, own in enumerate(encode([t or "" for t in b.column(1).to_pylist()])):
                ids = memoryview(own + b"\0\0\0\0")
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    row.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if keep_ids:
                        held.append(bytes(part))
            cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(held, pa.binary())] * keep_ids, [key, "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, schema)


def brackets(gap: np.ndarray) -> np.ndarray:
    """For gaps (True) and pieces in falling order, the place of the gap that each piece takes: the nearest free one before it; -1 without."""
    step = np.where(gap, 1, -1)
    depth = np.cumsum(step)
    low = np.minimum.accumulate(np.minimum(depth, 0))
    lone = ~gap & (np.diff(low, prepend=0) < 0)  # pieces that find all gaps before them taken
    rest = np.flatnonzero(~lone)
    opens = gap[rest]
    level = np.cumsum(step[rest]) + ~opens
    order = np.argsort(level, kind="stable")  # on a level gaps and pieces take turns
    one, two = order[:-1], order[1:]
    pair = opens[one] & ~opens[two] & (level[one] == level[two])
    out = np.full(len(gap), -1)
    out[rest[two[pair]]] = rest[one[pair]]
    return out


def swept(items: DataFrame, n: int) -> DataFrame:
    """part, gap, id, size, sequence (of pieces that found one), place (of the others among their kind in their part) of all pieces and of
    the gaps left; part numbers n ranges of falling size."""
    order = [F.col("size").desc(), F.col("gap").desc(), F.col("id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # numbers only, MANY rows at most
        if not held:
            return
        t = pa.Table.from_batches(held)
        part, gap, ids, size = (t.column(i).to_numpy() for i in range(4))
        mate = brackets(gap)
        lone = np.ones(len(gap), dtype=bool)
        lone[mate[mate >= 0]] = False
        lone[mate >= 0] = False
        place = np.where(gap, np.cumsum(gap & lone), np.cumsum(~gap & lone)) - 1
        keep = lone | ~gap
        found = pa.array(ids[np.maximum(mate, 0)][keep], mask=(mate < 0)[keep])
        yield pa.RecordBatch.from_arrays([*[pa.array(x[keep]) for x in (part, gap, ids, size)], found, pa.array(place[keep], mask=~lone[keep])], ["part", "gap", "id", "size", "sequence", "place"])

    held = items.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "gap", "id", "size")
    return held.mapInArrow(run, "part int, gap boolean, id long, size long, sequence long, place long")


def spans(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(part, first, end, part of gaps, place of the first one's gap) from the pieces and gaps left over in each part: pieces take
    the gaps of the nearest part before theirs, from the last one on; two rows per part at most."""
    out, free = [], []
    for part, pieces, gaps in sorted(left):
        at = 0
        while at < pieces and free:
            of, k = free.pop()
            here = min(k, pieces - at)
            out.append((part, at, at + here, of, k - 1))
            at += here
            if here < k:
                free.append((of, k - here))
        if gaps:
            free.append((part, gaps))
    return out


def fitted(sweep: DataFrame) -> DataFrame:
    """id, size, sequence (null: none) of all pieces of a sweep, after what was left over in one part met what was left over in others."""
    spark = sweep.sparkSession
    counts = sweep.where("sequence is null").groupBy("part").agg(F.count_if(~F.col("gap")).alias("p"), F.count_if("gap").alias("g")).collect()
    runs = spans([(r["part"], r["p"], r["g"]) for r in counts])
    own = sweep.where(~F.col("gap"))
    if not runs:
        return own.select("id", "size", "sequence")
    run = spark.createDataFrame(runs, "_part int, _first long, _end long, _of int, _top long")
    lone = own.where("sequence is null").join(F.broadcast(run), (F.col("part") == F.col("_part")) & (F.col("place") >= F.col("_first")) & (F.col("place") < F.col("_end")), "left")
    lone = lone.select("id", "size", "_of", (F.col("_top") - F.col("place") + F.col("_first")).alias("_at"))
    gaps = sweep.where("gap").select(F.col("part").alias("_p"), F.col("place").alias("_g"), F.col("id").alias("sequence"))
    met = lone.where("_of is not null").join(gaps.hint("shuffle_hash"), (F.col("_of") == F.col("_p")) & (F.col("_at") == F.col("_g"))).select("id", "size", "sequence")
    none = lone.where("_of is null").select("id", "size", F.lit(None).cast("long").alias("sequence"))
    return own.where("sequence is not null").select("id", "size", "sequence").union(met).union(none)


def best_fit(parts: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """parts (written, numbered in _piece) with sequence_id and offset."""
    spark = parts.sparkSession
    size, free, lone = F.col("size"), F.col("free"), F.col("sequence").isNull()
    facts = {"n": F.count_if(lone), "top": F.max(F.when(lone, size)), "least": F.min(F.when(lone, size)), "sum": F.sum(F.when(lone, size)), "halves": F.count_if(lone & (2 * size > capacity))}
    fit = parts.select(F.col("_piece").alias("id"), F.col("length").alias("size"), F.lit(None).cast("long").alias("sequence"))
    left = fit.agg(*[c.alias(k) for k, c in facts.items()]).first().asDict()
    gaps, live, wide, opened, placed = None, 0, 0, 0, []  # live: gaps that hold a piece; wide: gaps that hold every piece
    while left["n"]:
        if not live:
            more = max(-(-left["sum"] // capacity), left["halves"])
            new = spark.range(opened, opened + more).select(F.col("id").alias("sequence"), F.lit(capacity).cast("long").alias("free"))
            gaps, live, wide, opened = new, more, more, opened + more  # the older gaps hold none of the pieces left
        places = F.greatest(F.lit(1), F.least(F.floor(free / left["top"]), F.lit(1 + left["n"] // max(1, wide)))).cast("int")
        first = F.array(free - (places - 1) * left["top"])
        slots = gaps.select(F.lit(True).alias("gap"), F.col("sequence").alias("id"), F.explode(F.concat(first, F.array_repeat(F.lit(left["top"]), places - 1))).alias("size"))
        items = slots.union(fit.where(lone).select(F.lit(False), "id", "size"))
        rows, n = live + 2 * left["n"], int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        k = len(placed)
        sweep = settled(swept(items, max(1, min(n, rows // FEW), rows // MANY)), f"sweep-{k}")
        seen = Observation(f"pieces-{k}")
        fit = settled(fitted(sweep).observe(seen, *[c.alias(k) for k, c in facts.items()]), f"fit-{k}", sweep)
        left = seen.get
        placed.append(fit)
        if left["n"]:
            taken = fit.where(~lone).select("sequence", (-size).alias("free"))
            now = gaps.union(taken).groupBy("sequence").agg(F.sum("free").alias("free")).where(free >= left["least"])
            seen = Observation(f"gaps-{k}")
            gaps = settled(now.observe(seen, F.count("*").alias("live"), F.count_if(free >= left["top"]).alias("wide")), f"gaps-{k}", gaps)
            live, wide = seen.get["live"], seen.get["wide"]
    if not placed:
        return parts.drop("_piece").withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    all_placed = reduce(DataFrame.union, [f.where(~lone).select("id", "size", "sequence", F.lit(k).alias("round")) for k, f in enumerate(placed)])
    before = Window.partitionBy("sequence").orderBy("round", "id").rowsBetween(Window.unboundedPreceding, -1)  # a sequence holds capacity pieces at most
    at = settled(all_placed.select("id", F.col("sequence").alias("sequence_id"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")), "piece-places", *placed)
    return parts.join(at.hint("shuffle_hash"), parts["_piece"] == at["id"]).drop("_piece", "id")


def best_fit_packing(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    parts = pieces(docs, vocabulary, key, text, capacity, keep_ids).withColumn("_piece", F.monotonically_increasing_id())
    return best_fit(settled(parts, "tokens", rows=256), key, capacity)


def production_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), production_vocabulary())
