"""Ids and texts of the prefix table against the library, on whole tables and on hostile texts."""

import hashlib
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prismview.llm import sentence_pieces as s
from prismview.llm.queries import QUERIES


@pytest.fixture(scope="module")
def pieces():
    return s.piece_table(s.production_model())


@settings(max_examples=600, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    pieces = s.piece_table(s.production_model())
    assert pieces.ids(text) == pieces.model.encode(text)


def test_pieces_side_by_side(pieces):
    rng = random.Random(11)
    known = list(pieces.text.values())
    for _ in range(5000):
        text = "".join(rng.choices(known, k=rng.randint(1, 7)))
        assert pieces.ids(text) == pieces.model.encode(text), text


def test_runs_of_equal_scores(pieces):
    """Pieces of blanks and of signs have the same score, so that only their places decide."""
    rng = random.Random(12)
    for _ in range(3000):
        text = "".join(rng.choice(" -=*#/\\_.\n\t") * rng.randint(1, 40) for _ in range(rng.randint(1, 5)))
        assert pieces.ids(text) == pieces.model.encode(text), text


def test_each_prefix_has_one_last_piece(pieces):
    word = "▁internationalisation中\U0001D11Eofhyperbolic----thethethe"
    last, length = pieces.last_pieces(word)
    for end in range(1, len(word) + 1):
        own = pieces.merged(word[:end])[-1]
        assert (pieces.text[last[end]] if length[end] else word[end - 1]) == own
        if length[end]:
            fits = [m for e, m in pieces.matches.iter(word) if e + 1 == end and pieces.compatible(last[end - m[1]], m[0])]
            assert fits == [(last[end], length[end])]


def test_a_text_without_blanks_takes_linear_time(pieces):
    text = "".join(random.Random(5).choices("abcdefghijklmnopqrst", k=400_000))
    began = time.time()
    assert pieces.ids(text) == pieces.model.encode(text)
    assert time.time() - began < 30


def test_bounded_memory(monkeypatch):
    small = s.PieceTable(s.production_model())
    monkeypatch.setattr(small, "WORDS", 10)
    monkeypatch.setattr(small, "PAIRS", 20)
    text = " ".join(f"word{i} other{i * i}" for i in range(500))
    assert small.ids(text) == small.model.encode(text) and len(small.words) <= 10 and len(small.pairs) <= 20


def test_op11_brute_force(spark, small, pieces):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = pieces.model.encode(r["text"] or "")
        want[r["doc_id"]] = len(ids), sha(",".join(map(str, ids))), sha(pieces.model.decode(ids))
    got = QUERIES["op11_sentence_pieces"](spark, small).collect()
    assert len(got) == len(want) and {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


def test_cases(spark, pieces):
    long = "nobreak" * 100_000
    rows = [(1, None, "x"), (2, "", "x"), (3, long, None), (3, long, "y"), (None, " a  b\n", "z"), (4, "▁marked text", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = s.decoded(s.sentence_pieces(docs, s.production_model()), s.production_model()).collect()
    want = [(k or 0, pieces.model.encode(t or "")) for k, t, _ in rows]
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in got) == sorted(want)
    assert all(r["decoded"] == pieces.model.decode(r["ids"]) for r in got) and {r["decoded"] for r in got if r["doc_id"] in (1, 2)} == {""}
    assert s.sentence_pieces(docs.limit(0), s.production_model()).count() == 0
    none = spark.createDataFrame([(None,), ([5],)], "ids array<int>")
    assert sorted((r["decoded"] is None for r in s.decoded(none, s.production_model()).collect())) == [False, True]


def test_other_models_are_errors(tmp_path):
    with pytest.raises(Exception):
        s.PieceTable(str(tmp_path / "none.model"))
