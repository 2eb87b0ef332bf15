r"""Fill-in-middle transformation by ropes.

A text is a binary tree (a rope) whose leaves hold a few whole lines each and know how many units (lines
``[^\n]*\n|[^\n]+``) and how many code points they hold; inner nodes know the sums. The tree is split at two unit ranks
into prefix, middle and suffix, and these are concatenated in the order of the form, with sentinels as leaves between them:
no text is copied before the result is rendered. The inverse makes a rope of the output, splits it at the code-point ranks of the
sentinels and concatenates the parts in their first order. Both run in Arrow tasks, a text at a time, so a row's memory is a few
times its text.

Which ranks and form a row gets follows from the SHA-256 of a seed and its key alone, so it doesn't depend on how the rows
are dealt.

Edge cases: a null text is an empty one; empty texts, and texts that hold a sentinel, stay as they are (plain); a text of one
line has an empty prefix or suffix; a null key is hashed as an empty string, and equal keys draw alike, so repeated rows give repeated
results; an empty table gives an empty result; further columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismview.llm.common import TEXTS, settled, table

PREFIX, SUFFIX, MIDDLE = SENTINELS = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50
#: Characters that a leaf holds, about; a longer line is a leaf of its own.
LEAF = 512


class Rope:
    """Text as a tree: ``units`` lines and ``chars`` code points; ``text`` in a leaf, ``left`` and ``right`` in an inner node."""

    __slots__ = ("chars", "left", "right", "text", "units")

    def __init__(self, units: int, chars: int, text: str | None = None, left: Rope | None = None, right: Rope | None = None):
        self.units, self.chars, self.text, self.left, self.right = units, chars, text, left, right

    @classmethod
    def leaf(cls, text: str) -> Rope:
        return cls(text.count("\n") + (text[-1:] not in ("\n", "")), len(text), text)

    @classmethod
    def of(cls, text: str) -> Rope:
        """A balanced tree of a whole text; leaves end at line ends."""
        leaves, at = [], 0
        while at < len(text):
            end = text.find("\n", min(at + LEAF, len(text)) - 1) + 1 or len(text)
            leaves.append(cls.leaf(text[at:end]))
            at = end
        while len(leaves) > 1:
            leaves = [joined(*leaves[i:i + 2]) for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else EMPTY

    def render(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if node.text is not None:
                out.append(node.text)
            else:
                todo += node.right, node.left
        return "".join(out)


EMPTY = Rope(0, 0, "")


def joined(*parts: Rope) -> Rope:
    """The parts one after the other. A unit is the same in the whole as in its part, so parts end at line ends, but for the last."""
    out = EMPTY
    for p in parts:
        out = (out if not p.chars else p) if not out.chars or not p.chars else Rope(out.units + p.units, out.chars + p.chars, None, out, p)
    return out


def split(rope: Rope, rank: int, size: Callable[[Rope], int], cut: Callable[[str, int], int]) -> tuple[Rope, Rope]:
    """The rope up to and from a rank. size: a node's count; cut: where in a leaf's text so many end."""
    left, right = EMPTY, EMPTY
    while rope.text is None:
        if rank < size(rope.left):
            rope, right = rope.left, joined(rope.right, right)
        else:
            rope, left, rank = rope.right, joined(left, rope.left), rank - size(rope.left)
    at = cut(rope.text, rank)
    return joined(left, Rope.leaf(rope.text[:at])), joined(Rope.leaf(rope.text[at:]), right)


def _line_end(text: str, n: int) -> int:
    at = 0
    for _ in range(n):
        at = text.find("\n", at) + 1 or len(text)
    return at


def split_units(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    return split(rope, rank, lambda r: r.units, _line_end)


def split_chars(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    return split(rope, rank, lambda r: r.chars, lambda _, n: n)


def drawn(key: object, seed: int = SEED) -> list[int]:
    """Four unsigned 32-bit numbers of a key."""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(h[i:i + 4], "big") for i in (0, 4, 8, 12)]


def transformed(text: str, draw: list[int], rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and middle, output) of a text."""
    rope, (h1, h2, h3, h4) = Rope.of(text), draw
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= rate:
        return rope.units, "plain", None, None, text
    first, second = sorted((h1 % (rope.units + 1), h2 % (rope.units + 1)))
    head, suffix = split_units(rope, second)
    prefix, middle = split_units(head, first)
    p, s, m = map(Rope.leaf, SENTINELS)
    if h4 % 100 < spm_rate:
        return rope.units, "spm", prefix.chars, middle.chars, joined(s, suffix, p, prefix, m, middle).render()
    return rope.units, "psm", prefix.chars, middle.chars, joined(p, prefix, s, suffix, m, middle).render()


_MARKS = re.compile("|".join(map(re.escape, SENTINELS)))


def restored(output: str, form: str) -> str:
    """The text that ``transformed`` made an output of."""
    if form == "plain":
        return output
    rope, parts = Rope.of(output), {}
    for m in reversed(list(_MARKS.finditer(output))):
        rope, part = split_chars(rope, m.start())
        parts[m[0]] = split_chars(part, len(m[0]))[1]
    return joined(parts[PREFIX], parts[MIDDLE], parts[SUFFIX]).render()


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """key, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output of every row.

    rate: rows of a hundred that are transformed; spm_rate: rows of a hundred of these whose suffix comes first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [transformed(t or "", drawn(k, seed), rate, spm_rate) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)]], [key, "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(outputs: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with ``text``, rebuilt from output and form alone."""
    names = outputs.columns
    at = names.index("output"), names.index("form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [restored(o, f) for o, f in zip(*(b.column(i).to_pylist() for i in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, "text"])

    return outputs.mapInArrow(run, T.StructType([*outputs.schema, T.StructField("text", T.StringType())]))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    digests = [F.sha2(F.col(c), 256).alias(f"{name}_sha256") for c, name in (("output", "output"), ("text", "restored"))]
    return settled(both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests), "fill-in-middle", rows=TEXTS)


SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS units, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2,
  ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, n, form, t, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
