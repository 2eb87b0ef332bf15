"""SentencePiece encoding and decoding by a table of each prefix's last piece.

A merging (BPE) model's encoding has two properties: a run of neighbouring pieces is itself the encoding of its text, and a
sequence of pieces is an encoding if every two neighbours are one (they are compatible). So each prefix of a text has exactly
one last piece: of the pieces that end there, the one that is compatible with the last piece of what stands before it. An
automaton of all pieces lists what ends at each place; the table is filled from left to right, and the ids are read backwards
from its end. The work grows with the text's length, also where there is nothing to cut it at.

The test of a pair runs the model's merges over the two pieces' characters (best score first, then the leftmost, so pieces with
equal scores are right as well) and is remembered. Characters without a piece are bytes; nothing merges with them. No piece holds a
word mark after another character, so words are encoded one by one and short ones are remembered; for a model with such
pieces a whole text is one word.

Both directions are Arrow tasks without a shuffle; what is remembered is bounded.

Edge cases: a null or empty text has no ids and decodes to an empty text; keys may be null or repeated; an empty table gives an
empty result; further columns are dropped, whatever their names. A model of another kind than merging pieces with bytes as the
last resort is an error.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismview.llm.common import TEXTS, settled, table

MARK = "▁"
SAMPLES = ("", " ", "the  internationalisation\n\tof 2024", "    ----====€é\U0001D11E\0", "<s> ▁x")
_loaded: dict[str, PieceTable] = {}


class PieceTable:
    """Encoding and decoding by the pieces of a model file."""

    #: Words and pairs that are remembered at most, and the length of a word that is.
    WORDS, PAIRS, SHORT = 400_000, 1_000_000, 64

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        named = [(i, m.id_to_piece(i)) for i in range(m.get_piece_size())]
        pieces = [(i, p) for i, p in named if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        self.text = dict(pieces)
        self.score = {p: m.get_score(i) for i, p in pieces}
        self.byte = {int(p[1:-1], 16): i for i, p in named if m.is_byte(i)}
        self.matches = ahocorasick.Automaton()
        for i, p in pieces:
            self.matches.add_word(p, (i, len(p)))
        self.matches.make_automaton()
        self.parts = re.compile(f"{MARK}*[^{MARK}]*" if not any(MARK in p.lstrip(MARK) for _, p in pieces) else r"[\s\S]*")
        self.size = m.get_piece_size()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        if len(self.byte) < 256 or any(m.is_unused(i) for i, _ in pieces) or any(self.ids(t) != m.encode(t) for t in SAMPLES):
            raise ValueError(f"{path} isn't a model of merging pieces with bytes as the last resort")

    def merged(self, text: str) -> list[str]:
        """The pieces that the merges make of a short text."""
        parts, score = list(text), self.score
        while True:
            found = [(-score[both], k) for k in range(len(parts) - 1) if (both := parts[k] + parts[k + 1]) in score]
            if not found:
                return parts
            k = min(found)[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    def compatible(self, last: int, piece: int) -> bool:
        """Whether a piece can follow the last one; -1 stands for the start and for bytes."""
        if len(self.pairs) >= self.PAIRS:
            self.pairs.clear()
        want = [self.text[piece]] if last < 0 else [self.text[last], self.text[piece]]
        known = self.pairs[last * self.size + piece] = self.merged("".join(want)) == want
        return known

    def last_pieces(self, word: str) -> tuple[list[int], list[int]]:
        """For each prefix of a word its last piece and that one's length; -1 and 0 for the empty one and after a character without a piece."""
        last, length = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        known, size, compatible = self.pairs.get, self.size, self.compatible
        for end, (piece, n) in self.matches.iter(word):
            end += 1
            if not length[end]:
                before = last[end - n]
                fits = known(before * size + piece)
                if compatible(before, piece) if fits is None else fits:
                    last[end], length[end] = piece, n
        return last, length

    def encoded(self, word: str) -> bytes:
        """Ids of a word as native 32-bit numbers."""
        last, length = self.last_pieces(word)
        at, out = len(word), array("i")
        while at:
            if length[at]:
                out.append(last[at])
                at -= length[at]
            else:
                at -= 1
                out.extend(self.byte[b] for b in reversed(word[at].encode()))
        out.reverse()
        return out.tobytes()

    def raw(self, text: str) -> bytes:
        words, out = self.words, []
        for word in self.parts.findall(self.model.normalize(text)):
            ids = words.get(word)
            if ids is None:
                ids = self.encoded(word)
                if len(word) <= self.SHORT:
                    if len(words) >= self.WORDS:
                        words.clear()
                    words[word] = ids
            out.append(ids)
        return b"".join(out)

    def ids(self, text: str) -> list[int]:
        return array("i", self.raw(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def piece_table(path: str) -> PieceTable:
    if path not in _loaded:
        _loaded[path] = PieceTable(path)
    return _loaded[path]


def sentence_pieces(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int) of every row's text. model: the path of the model file on every node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(model)
        for b in batches:
            raw = [pieces.raw(t or "") for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *[len(r) // 4 for r in raw]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), dtype=np.int32)))], [key, "ids"])

    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decoded(tokens: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """tokens with the text of their ids; null for null ids."""
    names = tokens.columns
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(model)
        for b in batches:
            held = b.column(at)
            flat, ends = held.values.to_numpy(), held.offsets.to_numpy()
            spans = zip(held.is_valid().to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)
            texts = [pieces.decode(flat[i:j].tolist()) if there else None for there, i, j in spans]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, text])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema, T.StructField(text, T.StringType())]))


def production_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = production_model()
    both = decoded(sentence_pieces(table(spark, sf_dir, "documents"), model), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    out = both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return settled(out, "sentence-pieces", rows=TEXTS)
