"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns by turns, the user first. Dynamic
programming over that automaton (its state is the last role) chooses for every turn to keep it, to merge it into the turn
before, to give it another role, or to put an empty turn in front; ties go to the earlier of these. The repaired turns are
rendered with start and end marks.

A step of the program is a small matrix in (min, +) arithmetic, so a conversation may be cut anywhere: rows are
range-sorted by conversation and turn; a task runs the program over its stretch of a conversation from every entry state;
the few stretches of conversations that cross tasks (two per task at most) are put together on the driver; then every
stretch is decided between its entry and exit state. A conversation of any length is thus spread over many tasks.

Output: a row per input turn and per inserted turn, in the order ``seq``; the pieces of a conversation, concatenated in that
order, are the rendered text. An end mark stands at the start of the piece after it, and after the last piece.

A start or end mark within a text can't forge a turn: it gets a backslash after its ``<`` (one more, where it has some already, so
that the texts can be read back).

Edge cases: conversation and turn keys may be of any type that can be ordered; a null or unknown role can take any role at the cost of an unknown one; a null text is empty; turns that are
null come first; equal turns keep the order in which they are read; rows repeated are turns of their own; null
conversation ids form one conversation; an empty table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismview.llm.common import settled, table

ROLES = ("system", "user", "assistant")
NONE, SYSTEM, USER, ASSISTANT = -1, 0, 1, 2
STATES = (NONE, SYSTEM, USER, ASSISTANT)
#: The legal successors of a state.
NEXT = {NONE: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
COST = {"merge": 1, "insert": 3, "relabel": 2, "unknown": 1}
OPEN, CLOSE, JOIN = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"
MARK = re.compile(r"<(\\*)\|im_(start|end)\|>")


def escaped(text: str) -> str:
    return MARK.sub(r"<\\\1|im_\2|>", text) if "|im_" in text else text


def options(state: int, role: int | None) -> list[tuple[int, int, str, int | None]]:
    """(cost, new state, action, role inserted before) of the ways to take a turn of a role (None: unknown) in a state."""
    out = []
    for to in (SYSTEM, USER, ASSISTANT):
        other = 0 if to == role else COST["unknown"] if role is None else COST["relabel"]
        said = "" if to == role else "relabel"
        if to in NEXT[state]:
            out.append((other, to, said or "keep", None))
        elif to == state:
            out.append((other + COST["merge"], to, "+".join(filter(None, (said, "merge"))), None))
        else:
            for between in NEXT[state]:
                if to in NEXT[between]:
                    out.append((other + COST["insert"], to, "+".join(filter(None, ("insert", said))), between))
    return out


WAYS = {(s, r): options(s, r) for s in STATES for r in (None, 0, 1, 2)}


def forward(entry: int, roles: list[int | None]) -> list[dict[int, tuple]]:
    """For each turn and state after it: (cost, turns and pieces so far, state before, action, role inserted)."""
    best, steps = {entry: (0, 0, 0)}, []
    for role in roles:
        new: dict[int, tuple] = {}
        for state, (cost, out, pieces) in best.items():
            for more, to, action, between in WAYS[state, role]:
                two = between is not None
                c = (cost + more, out + (0 if "merge" in action else 1 + two), pieces + 1 + two, state, action, between)
                if to not in new or c[:3] < new[to][:3]:
                    new[to] = c
        steps.append(new)
        best = {k: v[:3] for k, v in new.items()}
    return steps


def backward(steps: list[dict[int, tuple]], exit_state: int) -> list[tuple[int, tuple]]:
    path, state = [], exit_state
    for step in reversed(steps):
        path.append((state, step[state]))
        state = step[state][3]
    return path[::-1]


def cheapest(costs: dict[int, tuple]) -> int:
    return min(costs, key=lambda s: (*costs[s][:3], s))


def assembled(stretches: list[dict]) -> dict[tuple[int, object], tuple[int, int, int, int, bool]]:
    """(part, conversation) -> (entry state, exit state, turns and pieces before, whether it ends there) for conversations in several parts.

    stretches: part, conv, and table: entry state -> exit state -> (cost, turns, pieces).
    """
    by: dict[object, list[dict]] = {}
    for s in sorted(stretches, key=lambda s: s["part"]):
        by.setdefault(s["conv"], []).append(s)
    out = {}
    for conv, own in by.items():
        best, back = {NONE: (0, 0, 0)}, []
        for s in own:
            new: dict[int, tuple] = {}
            for entry, before in best.items():
                for to, more in s["table"][entry].items():
                    c = tuple(x + y for x, y in zip(before, more, strict=True))
                    if to not in new or c < new[to][:3]:
                        new[to] = (*c, entry, before)
            back.append(new)
            best = {k: v[:3] for k, v in new.items()}
        state = cheapest(best)
        for i in range(len(own) - 1, -1, -1):
            *_, entry, (_, turns, pieces) = back[i][state]
            out[own[i]["part"], conv] = (entry, state, turns, pieces, i == len(own) - 1)
            state = entry
    return out


def _stretches(batches: Iterator[pa.RecordBatch]):
    """(part, tag, conversation, rows) of each run of rows; rows: (turn, role, text)."""
    at, own, rows = None, None, []
    for b in batches:
        for part, tag, conv, turn, role, text in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if (part, tag) != at:
                if rows:
                    yield *at, own, rows
                at, own, rows = (part, tag), conv, []
            rows.append((turn, ROLES.index(role) if role in ROLES else None, escaped(text or "")))
    if rows:
        yield *at, own, rows


def chat_repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn (null for an inserted one), seq, out_turn, role, action, cost, rendered."""
    spark = turns.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    kinds = {name: turns.schema[c].dataType.simpleString() for name, c in (("conv", conv), ("turn", turn))}
    few = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.lower(F.trim(F.col(role))).alias("role"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    few = few.withColumn("tag", F.when(F.col("conv").isNull(), "").otherwise(F.concat_ws(":", F.xxhash64("conv").cast("string"), F.hash("conv").cast("string"))))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("row")]
    held = settled(few.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "turns")
    dealt = held.repartitionByRange(n, "part").sortWithinPartitions("part", *order).select("part", "tag", "conv", "turn", "role", "text", "row")
    # a conversation's tag (96 bits of hashes) is the same wherever it is read, which the keys of many types aren't;
    # a conversation crosses parts if its rows lie in several: only the first and last of a part can
    ends = held.groupBy("part").agg(F.min(F.struct(F.col("conv").isNotNull().alias("k"), "conv", "tag"))["tag"].alias("a"), F.max(F.struct(F.col("conv").isNotNull().alias("k"), "conv", "tag"))["tag"].alias("z")).collect()
    seen: dict[str, int] = {}
    for r in ends:
        for c in {r["a"], r["z"]}:
            seen[c] = seen.get(c, 0) + 1
    crossing = {c for c, k in seen.items() if k > 1}  # as many as there are parts at most

    def summed(batches):
        for part, tag, _, rows in _stretches(batches):
            roles = [r[1] for r in rows]
            for entry in STATES:
                last = forward(entry, roles)[-1]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(last), pa.int32()), pa.array([tag] * len(last)), pa.array([entry] * len(last), pa.int32()), pa.array(list(last), pa.int32()), pa.array([v[0] for v in last.values()], pa.int64()), pa.array([v[1] for v in last.values()], pa.int64()), pa.array([v[2] for v in last.values()], pa.int64())], ["part", "tag", "entry", "exit", "cost", "out", "pieces"])

    fixed = {}
    if crossing:
        tables: dict[tuple, dict] = {}
        for r in dealt.where(F.col("tag").isin(list(crossing))).select("part", "tag", "conv", "turn", "role", F.lit("").alias("text")).mapInArrow(summed, "part int, tag string, entry int, exit int, cost long, out long, pieces long").collect():
            tables.setdefault((r["part"], r["tag"]), {}).setdefault(r["entry"], {})[r["exit"]] = (r["cost"], r["out"], r["pieces"])
        fixed = assembled([{"part": p, "conv": tag, "table": t} for (p, tag), t in tables.items()])
    known = spark.sparkContext.broadcast(fixed)

    def repaired(batches):
        out: list[tuple] = []
        own, batches = _kinds(batches)
        for part, tag, c, rows in _stretches(batches):
            entry, leave, before, seq, last = known.value.get((part, tag), (NONE, None, 0, 0, True))
            steps = forward(entry, [r[1] for r in rows])
            path = backward(steps, cheapest(steps[-1]) if leave is None else leave)
            number, opened, paid = before, entry != NONE, 0
            for i, ((t, _, words), (state, (cost, _, _, _, action, between))) in enumerate(zip(rows, path, strict=True)):
                ends = CLOSE if last and i == len(rows) - 1 else ""
                if between is not None:
                    out.append((c, None, seq, number, ROLES[between], "insert", COST["insert"], (CLOSE if opened else "") + OPEN.format(ROLES[between])))
                    seq, number, opened, paid = seq + 1, number + 1, True, paid + COST["insert"]
                if "merge" in action:
                    piece = JOIN + words
                else:
                    piece, number = (CLOSE if opened else "") + OPEN.format(ROLES[state]) + words, number + 1
                out.append((c, t, seq, number - 1, ROLES[state], action.removeprefix("insert+").replace("insert", "keep"), cost - paid, piece + ends))
                seq, opened, paid = seq + 1, True, cost
                if len(out) >= 512:
                    yield _batch(out, own)
                    out = []
        if out:
            yield _batch(out, own)

    got = dealt.drop("row").mapInArrow(repaired, f"conv {kinds['conv']}, turn {kinds['turn']}, seq long, out_turn long, role string, action string, cost long, rendered string")
    return got.select(F.col("conv").alias(conv), F.col("turn").alias(turn), "seq", "out_turn", "role", "action", "cost", "rendered")


def _kinds(batches: Iterator[pa.RecordBatch]) -> tuple[list[pa.DataType], Iterator[pa.RecordBatch]]:
    """The types of the keys, and the batches."""
    first = next(batches, None)
    return ([], iter(())) if first is None else ([first.schema.field(c).type for c in ("conv", "turn")], chain([first], batches))


def _batch(rows: list[tuple], own: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    kinds = [*own, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv", "turn", "seq", "out_turn", "role", "action", "cost", "rendered"])


def op7_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair(table(spark, sf_dir, "conversations"))
