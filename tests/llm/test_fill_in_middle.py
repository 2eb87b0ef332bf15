"""Ropes against plain slicing, and the round trip."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from prismview.llm import fill_in_middle as f

PARTS = st.lists(st.sampled_from(["a", "\n", "é", "\U0001D11E", "word " * 200, "<", "P>", "<P>", "\r\n"]), max_size=14).map("".join)


def plainly(text, draw):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((draw[0] % (len(units) + 1), draw[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in f.SENTINELS):
        return len(units), "plain", None, None, text
    form, out = ("spm", f"<S>{suffix}<P>{prefix}<M>{middle}") if draw[3] % 100 < 50 else ("psm", f"<P>{prefix}<S>{suffix}<M>{middle}")
    return len(units), form, len(prefix), len(middle), out


@settings(max_examples=400, deadline=None)
@given(PARTS, st.integers(0, 10 ** 9))
def test_equals_slices_and_goes_back(text, key):
    draw = f.drawn(key)
    got = f.transformed(text, draw)
    assert got == plainly(text, draw)
    assert f.restored(got[4], got[1]) == text


def test_splits_at_any_rank():
    rng = random.Random(13)
    text = "".join("x" * rng.choice([0, 1, 700]) + "\n" for _ in range(300)) + "end"
    rope, lines = f.Rope.of(text), text.splitlines(keepends=True)
    assert (rope.units, rope.chars, rope.render()) == (len(lines), len(text), text)
    for n in range(len(lines) + 1):
        a, b = f.split_units(rope, n)
        assert (a.render(), b.render()) == ("".join(lines[:n]), "".join(lines[n:])) and (a.units, b.units, a.chars) == (n, len(lines) - n, len(a.render()))
    for n in rng.sample(range(len(text) + 1), 50):
        a, b = f.split_chars(rope, n)
        assert (a.render(), b.render()) == (text[:n], text[n:]) and a.chars == n


def test_rates():
    assert all(f.transformed("a\nb\n", f.drawn(k), rate=0)[1] == "plain" for k in range(50))
    forms = [f.transformed("a\nb\n", f.drawn(k), spm_rate=20)[1] for k in range(2000)]
    assert 300 < forms.count("spm") < 500


def test_cases(spark):
    long = "line of a long text\n" * 200_000
    rows = [(1, None, "x"), (2, "", "x"), (3, long, None), (3, long, "y"), (None, "a\nb\nc", "z"), (4, "with <M> inside\n", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    got = f.restore(f.fill_in_middle(docs)).collect()
    assert sorted(((r["doc_id"] or 0, r["form"], r["text"]) for r in got)) == sorted((k or 0, f.transformed(t or "", f.drawn(k))[1], t or "") for k, t, _ in rows)
    assert {r["form"] for r in got if r["doc_id"] in (1, 2, 4)} == {"plain"} and all(r["prefix_chars"] is None for r in got if r["form"] == "plain")
    assert f.restore(f.fill_in_middle(docs.limit(0))).count() == 0
