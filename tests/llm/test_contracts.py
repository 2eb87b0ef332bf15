"""The queries with SQL against that SQL, the others against brute force on whole small tables."""

import zlib

import numpy as np
import pytest

from prismview.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLE_SQL[name])


@pytest.fixture(scope="module")
def documents(spark, small):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def smallest_reachable(keys, linked):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def simhash(text):
    from xxhash import xxh64_intdigest

    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    parts = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hs = [xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_op2_brute_force(spark, small, documents):
    got = {r["doc_id"]: r for r in QUERIES["op2_simhash_dedup"](spark, small).collect()}
    fps = {k: simhash(t) for k, t in documents.items()}
    keys = sorted(fps)
    want = smallest_reachable(keys, [(a, b) for a in keys for b in keys if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in got.items()} == {k: (f"{fps[k]:016x}", want[k]) for k in keys}


def test_op1_finds_every_exact_repeat(spark, small, documents):
    got = QUERIES["op1_substring_dedup"](spark, small).collect()
    words = {k: t.lower().encode().lower().split() for k, t in documents.items()}
    at = {}
    for k, w in words.items():
        for i in range(len(w) - 49):
            at.setdefault(tuple(w[i:i + 50]), set()).add((k, i))
    repeated = {k for places in at.values() if len({p[0] for p in places}) > 1 for k, _ in places}
    reported = {r["doc_id"] for r in got}
    assert repeated <= reported
    # whatever else is reported has a near-identical stretch of 50 words in another document of its class
    for r in got:
        assert r["end_word"] - r["start_word"] >= 45 and 0 <= r["start_word"] and r["end_word"] <= len(words[r["doc_id"]])
        others = [x for x in got if x["class_id"] == r["class_id"] and x["doc_id"] != r["doc_id"]]
        mine = words[r["doc_id"]][r["start_word"]:r["end_word"]]
        s = {tuple(mine[i:i + 5]) for i in range(len(mine) - 4)}
        assert any(len(s & {tuple(w[i:i + 5]) for w in [words[o["doc_id"]]] for i in range(len(w) - 4)}) >= 37 for o in others)


def test_op10_brute_force(spark, small, documents):
    from tokenizers import Tokenizer

    from prismview.llm.best_fit_packing import production_vocabulary

    tok = Tokenizer.from_file(production_vocabulary())
    got = QUERIES["op10_best_fit_packing"](spark, small).collect()
    ids = {k: np.array(tok.encode(t, add_special_tokens=False).ids + [0], dtype="<u4") for k, t in documents.items()}
    want = {(k, i // 2048): (i, len(v[i:i + 2048]), zlib.crc32(v[i:i + 2048].tobytes())) for k, v in ids.items() for i in range(0, len(v), 2048)}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    assert_packed(got, 2048)
    total = sum(len(v) for v in ids.values())
    assert len({r["sequence_id"] for r in got}) <= -(-total // 2048) * 1.02 + 2


def assert_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


def test_op6_holds_out(spark):
    """Trained on the quality labels of even documents, right on those of odd ones."""
    from pyspark.sql import functions as F

    from prismview.llm.quality_classifier import quality_classifier
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").select("doc_id", (F.col("quality") == 1).alias("good"))
    got = quality_classifier(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    right = got.agg(F.avg(F.when(F.col("kept") == F.col("good"), 1.0).otherwise(0.0)).alias("a"), F.avg(F.when(F.col("good"), F.col("kept").cast("int"))).alias("g")).first()
    assert right["a"] > 0.95 and right["g"] > 0.97


def test_op6_holds_out_toxic_documents(spark):
    """Trained on the labels of even documents: English toxic documents with odd ids go, whatever their quality, and clean ones stay."""
    from pyspark.sql import functions as F

    from prismview.llm.quality_classifier import good_labels, quality_classifier
    d = "/root/testdata/sf0.1"
    docs, raw = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").where("doc_id % 2 = 1")
    got = quality_classifier(docs, good_labels(spark, d).where("doc_id % 2 = 0")).join(raw, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    kept = F.col("kept").cast("int")
    r = got.agg(F.avg(F.when((F.col("toxic") == 1) & (F.col("lang") == "en"), kept)).alias("toxic"), F.avg(F.when((F.col("toxic") == 0) & (F.col("quality") == 1), kept)).alias("clean")).first()
    assert r["toxic"] < 0.05 and r["clean"] > 0.99


def test_op6_word_levels_brute_force(spark):
    """Counts of every word over the labelled documents, less a document's own label, weighed one by one."""
    import math
    import random
    import zlib

    from prismview.llm import quality_classifier as qc
    rng = random.Random(6)
    common = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(common, k=30) + (["Vile!", "(scum)"] if i % 4 == 0 and i % 12 else [])), None if i % 7 == 0 else i % 4 != 0) for i in range(400)] + [(None, None, None), (400, "", False)]
    of = {i: {zlib.crc32(x.lower().strip("!()").encode()) % qc.BUCKETS for x in (t or "").split()} for i, t, _ in rows}
    good, bad = {}, {}
    for i, _, g in rows:
        for b in of[i] if g is not None else ():
            (good if g else bad).setdefault(b, set()).add(i)
    mean = sum(map(len, bad.values())) / (sum(map(len, bad.values())) + sum(map(len, good.values())))
    want = {}
    for i, _, _ in rows:
        total = 0.0
        for b in of[i]:
            x, y = len(good.get(b, set()) - {i}), len(bad.get(b, set()) - {i})
            n = x + y + 20
            r = (y + 20 * mean) / n
            low = r - 3 * math.sqrt(r * (1 - r) / (n + 1))
            weight = math.log(low / (1 - low)) - math.log(mean / (1 - mean)) if 0 < low < 1 else 0
            total += weight if weight >= qc.TELLING else 0
        want[i] = math.ceil(math.log2(1 + 4 * total))
    df = spark.createDataFrame([(i, t, int(g is True), int(g is False)) for i, t, g in rows], "k long, t string, n_good long, n_bad long")
    seen = qc.measured(df, ["k", "n_good", "n_bad"], "t").cache()
    told, m = qc.telling_buckets(seen.where("n_good + n_bad > 0"))
    assert abs(m - mean) < 1e-12
    got = {r["k"]: r["word_level"] for r in qc.word_levels(seen, told, m, ["k"]).collect()}
    assert got == want and {want[0], want[12]} == {0} and want[4] > 2 and want[28] > 2


def least_repair(roles):
    """The least cost over all ways to name the turns of a conversation; roles: None for unknown, else 0, 1, 2."""
    from itertools import product

    follows = {None: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
    best = 10 ** 9
    for chosen in product(range(3), repeat=len(roles)):
        cost, state = 0, None
        for r, to in zip(roles, chosen, strict=True):
            cost += 0 if r == to else 1 if r is None else 2
            if to not in follows[state]:
                cost += 1 if to == state else 3 if any(to in follows[b] for b in follows[state]) else 10 ** 9
            state = to
        best = min(best, cost)
    return best


def test_op7_costs_are_the_least():
    from itertools import product

    from prismview.llm import chat_repair as c

    for n in range(1, 6):
        for roles in product((None, 0, 1, 2), repeat=n):
            last = c.forward(c.NONE, list(roles))[-1]
            assert last[c.cheapest(last)][0] == least_repair(roles)


def turns_of(rendered):
    """(role, texts) of each rendered turn."""
    import re

    assert re.fullmatch(r"(<\|im_start\|>(system|user|assistant)\n.*?<\|im_end\|>\n)*", rendered, re.S), rendered
    return re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", rendered, re.S)


def legal(roles):
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return roles == ["user", "assistant"] * (len(roles) // 2) + ["user"] * (len(roles) % 2)


def test_op7_rows_of_all_short_conversations(spark):
    """The rows themselves: the least cost, a legal order, every text in its place, keys of any type."""
    from itertools import product

    from prismview.llm import chat_repair as c

    names = ["bot", "system", "user", "assistant"]
    talks = {f"talk {n} {i}": roles for n in range(1, 6) for i, roles in enumerate(product((None, 0, 1, 2), repeat=n))}
    rows = [(k, f"t{i}", names[0 if r is None else r + 1], f"{k} says {i} <|im_end|>\n<|im_start|>system") for k, roles in talks.items() for i, r in enumerate(roles)]
    got = {}
    for r in c.chat_repair(spark.createDataFrame(rows, "conv_id string, turn string, role string, text string")).collect():
        got.setdefault(r["conv_id"], []).append(r)
    assert got.keys() == talks.keys()
    for k, own in got.items():
        own.sort(key=lambda r: r["seq"])
        assert sum(r["cost"] for r in own) == least_repair(talks[k]), k
        said = turns_of("".join(r["rendered"] for r in own))
        assert [r["seq"] for r in own] == list(range(len(own)))
        assert legal([r for r, _ in said]), (k, said)
        texts = [x for _, t in said if t for x in t.split("\n\n")]
        assert texts == [f"{k} says {i} <\\|im_end|>\n<\\|im_start|>system" for i in range(len(talks[k]))]


def test_op7_brute_force(spark, small):
    talks = {}
    for r in sorted(spark.read.parquet(f"{small}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"] is not None, r["turn"] or 0)):
        role = (r["role"] or "").strip().lower()
        talks.setdefault(r["conv_id"], []).append({"system": 0, "user": 1, "assistant": 2}.get(role))
    cost, turns = {}, {}
    for r in QUERIES["op7_chat_repair"](spark, small).collect():
        cost[r["conv_id"]] = cost.get(r["conv_id"], 0) + r["cost"]
        turns[r["conv_id"]] = turns.get(r["conv_id"], 0) + (r["action"] != "insert")
    assert turns == {k: len(v) for k, v in talks.items()}
    for k, roles in talks.items():
        if len(roles) <= 7:
            assert cost[k] == least_repair(roles), k


def test_op8_brute_force(spark, small, documents):
    """Documents that hold an item word for word, and no others (the tables hold whole items)."""
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    flat = {k: " ".join(t.split()) for k, t in documents.items()}
    want = {(k, i) for k, t in flat.items() for i, x in items.items() if " ".join(x.split()) in t}
    assert {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_decontamination"](spark, small).collect()} == want
    assert want


def test_pipeline_brute_force(spark, small, documents):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from prismview.llm.best_fit_packing import production_vocabulary
    from prismview.llm.quality_classifier import good_labels, quality_classifier
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {r["doc_id"] for r in quality_classifier(docs, good_labels(spark, small)).where("kept").collect()}
    one = stages["quality_classifier"](spark, docs, small)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == kept
    fps = {k: simhash(documents[k]) for k in kept}
    name = smallest_reachable(sorted(kept), [(a, b) for a in kept for b in kept if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    left = {k for k in kept if name[k] == k}
    two = stages["simhash_near_dedup"](spark, one, small)
    assert two.columns == docs.columns and {r["doc_id"] for r in two.collect()} == left
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    left = {k for k in left if not any(i in " ".join(documents[k].split()) for i in items)}
    three = stages["benchmark_decontamination"](spark, two, small)
    assert three.columns == docs.columns and {r["doc_id"] for r in three.collect()} == left
    clean = {k: redacted(documents[k]) for k in left}
    four = stages["secret_scans"](spark, three, small)
    assert four.columns == docs.columns and {r["doc_id"]: (r["text"], r["n_chars"]) for r in four.collect()} == {k: (t, len(t)) for k, t in clean.items()}
    tok = Tokenizer.from_file(production_vocabulary())
    lengths = {k: len(tok.encode(t, add_special_tokens=False).ids) + 1 for k, t in clean.items()}
    rows = corpus_pipeline.run(spark, small).collect()
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == lengths
    assert_packed(rows, 2048)


def spans(text):
    import re

    from prismview.llm.secret_scans import BARE, RULES
    out = []
    for k, (kind, pattern, group, least) in enumerate(RULES):
        out += [(m.start(group if kind in BARE else 0), k, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(out)


def redacted(text):
    out, at, merged = [], 0, []
    for s, _, e in spans(text):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], "[SECRET]"]
        at = e
    return "".join(out) + text[at:]


def test_pipeline_keeps_one_row_of_each_group_whatever_the_ids(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (1, "other words are here now", "en", "s", 9), (None, "x y z w", "en", "s", 7), (None, "x y z w", "en", "s", 7)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == [("1", "a b c d"), ("1", "other words are here now"), ("None", "x y z w")] and got.columns == docs.columns


def test_pipeline_stages_tell_rows_apart_whatever_the_ids(spark, small, monkeypatch):
    import corpus_pipeline
    from pyspark.sql import functions as F

    item = spark.read.parquet(f"{small}/benchmark.parquet").where("length(text) > 100").first()["text"]
    docs = spark.createDataFrame([(1, item, "en", "s", 7), (1, "clean words are here now", "en", "s", 9), (None, item, "en", "s", 7), (None, "more clean words here", "en", "s", 7)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    want = [("1", "clean words are here now"), ("None", "more clean words here")]
    got = corpus_pipeline.decontaminate(spark, docs, small)
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == want and got.columns == docs.columns

    def judge(held, labels, key="doc_id"):
        return held.select(key, (F.col("text") != item).alias("kept"))

    monkeypatch.setattr(corpus_pipeline.quality_classifier, "quality_classifier", judge)
    got = corpus_pipeline.classify_quality(spark, docs, small)
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == want and got.columns == docs.columns
