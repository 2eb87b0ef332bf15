"""State machines along sorted keys of any size: a key's rows may lie in many partitions.

The rows are range-sorted by (key, order), so a partition holds a piece of one key, or the end of one, some whole keys and the beginning of
another. While they are written, each partition also writes one summary: what its first key's rows do to any state they are
entered with, and the state in which its last key leaves it. The driver folds the summaries in order, one at a time, into one entry
state per partition; the second pass runs the machine over each partition from its entry state, in streams of batches. So no task
ever holds a key, only its range, and the driver holds one state per partition.
"""

from __future__ import annotations

import math
import pickle
from bisect import bisect_left
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismview.functions.shared import settled

Columns = dict[str, np.ndarray]


class Machine(Protocol):
    """What is carried along a key; the state before its first row is None. ``columns`` are read as doubles, nulls as NaN."""

    columns: list[str]
    #: Columns that ``step`` adds (doubles).
    adds: list[str]

    def step(self, state: Any, rows: Columns) -> tuple[Any, np.ndarray | None, Columns]:
        """(state after the rows, which of them to keep or None for all, the added columns of all rows)."""

    def summary(self, rows: Columns) -> Any:
        """What the rows do to a state."""

    def after(self, state: Any, summary: Any) -> Any:
        """The state after rows of which only the summary is known."""


class Hysteresis:
    """Rows whose value has moved by more than ratio from that of the last such row; the first value counts, nulls never do.

    Whatever state a piece is entered with, the first row that counts is a record of the piece, its first value above or below
    some bound; from there on the way is the same. So the summary is the piece's running maxima and minima, each with the value at
    which its way ends; records with the same end are one.
    """

    adds: list[str] = []

    def __init__(self, value: str, ratio: float):
        self.columns, self.ratio = [value], ratio

    def step(self, state, rows):
        base, ratio, keep = state, self.ratio, []
        for v in rows[self.columns[0]].tolist():
            hit = v == v and (base is None or v > base * ratio or v < base / ratio)
            keep.append(hit)
            base = v if hit else base
        return base, np.array(keep, dtype=bool), {}

    def summary(self, rows):
        v = rows[self.columns[0]]
        v = v[~np.isnan(v)].tolist()
        ends = [0.0] * len(v)
        high, low = ([], []), ([], [])  # records from here on, the nearest last: values (negative for maxima, so that both rise), places
        for i in range(len(v) - 1, -1, -1):
            after = [at for (values, places), bound in ((high, -(v[i] * self.ratio)), (low, v[i] / self.ratio)) if (k := bisect_left(values, bound)) for at in (places[k - 1],)]
            ends[i] = ends[min(after)] if after else v[i]
            for (values, places), x in ((high, -v[i]), (low, v[i])):
                while values and values[-1] >= x:
                    values.pop(), places.pop()
                values.append(x), places.append(i)
        out = []
        for (values, places), other in ((high, low), (low, high)):
            kept: list[tuple[float, int, float]] = []
            others = sorted(other[1])
            for x, at in zip(values, places, strict=True):  # from the farthest record to the nearest
                if kept and kept[-1][2] == ends[at] and bisect_left(others, at) == bisect_left(others, kept[-1][1]):
                    kept[-1] = kept[-1][0], at, ends[at]
                else:
                    kept.append((x, at, ends[at]))
            out.append(kept)
        return (ends[0] if v else None), *out

    def after(self, state, summary):
        first, high, low = summary
        if state is None or first is None:
            return first if first is not None else state
        found = []
        for records, bound in ((high, -(state * self.ratio)), (low, state / self.ratio)):
            k = bisect_left(records, bound, key=lambda r: r[0])
            found += [records[k - 1][1:]] * (k > 0)
        return min(found)[1] if found else state


class Smoothing:
    """A value smoothed with time constant tau, at every row; a null value leaves it as it is."""

    def __init__(self, seconds: str, value: str, tau: float, name: str = "smooth"):
        self.columns, self.tau, self.adds = [seconds, value], tau, [name]

    def step(self, state, rows):
        at, s, out = *(state or (None, math.nan)), []
        for t, v in zip(*(rows[c].tolist() for c in self.columns), strict=True):
            if v == v:
                s = v if at is None else s + (v - s) * -math.expm1(-max(0.0, t - at) / self.tau)
                at = t
            out.append(s)
        return (None if at is None else (at, s)), None, {self.adds[0]: np.array(out, dtype=float)}

    def summary(self, rows):
        t, v = (rows[c][~np.isnan(rows[self.columns[1]])] for c in self.columns)
        if not len(t):
            return None
        rest = {c: x for c, x in zip(self.columns, (t[1:], v[1:]), strict=True)}
        (end, own), *_ = self.step((float(t[0]), 0.0), rest)
        return float(t[0]), float(v[0]), end, own, math.exp(-(end - float(t[0])) / self.tau)

    def after(self, state, summary):
        if summary is None:
            return state
        first, v, end, own, share = summary
        (_, s), *_ = self.step(state, {self.columns[0]: np.array([first]), self.columns[1]: np.array([v])})
        return end, own + share * s


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[Any, slice]]:
    """(key's text, rows) of the stretches of equal keys in a batch."""
    keys = b.column("_k").to_pylist()
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield keys[start], slice(start, i)
            start = i


def _rows(b: pa.RecordBatch, machine: Machine, at: slice) -> Columns:
    part = b.slice(at.start, at.stop - at.start)
    return {c: part.column(c).cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False) for c in machine.columns}


def _joined(parts: list[Columns]) -> Columns:
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def carried(df: DataFrame, key: str, order: list[str], machine: Machine) -> DataFrame:
    """df's rows that the machine keeps, with the columns that it adds. The order should be total; null keys are one key."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    names = df.columns
    held = (df.withColumn("_k", F.col(key).cast("string")).repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
            .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = b = None
        first_rows, last_rows, several = [], [], False
        for b in batches:
            if not b.num_rows:
                continue
            for k, at in _pieces(b):
                rows = _rows(b, machine, at)
                if not first_rows:
                    first = last = k
                if k != last:
                    several, last, last_rows = True, k, []
                (last_rows if several else first_rows).append(rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.binary())], [*b.schema.names, "_summary"])
            part = b.slice(0, 1)
        if first_rows:
            does = (last, machine.step(None, _joined(last_rows))[0]) if several else None
            told = pickle.dumps((first, machine.summary(_joined(first_rows)), does))
            kept = [c if n == "_part" else pa.nulls(1, c.type) for n, c in zip(part.schema.names, part.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([told], pa.binary())], [*part.schema.names, "_summary"])

    nullable = [T.StructField(f.name, f.dataType) for f in held.schema]
    held = settled(held.mapInArrow(scan, T.StructType([*nullable, T.StructField("_summary", T.BinaryType())])), "carried")
    entry: dict[int, Any] = {}  # of each partition whose first key goes on from the one before: the state it is entered with
    key_before, state = object(), None
    for r in held.where("_summary is not null").select("_part", "_summary").orderBy("_part").toLocalIterator():
        first, does, last = pickle.loads(r["_summary"])
        if first == key_before:
            entry[r["_part"]] = state
        key_before, state = (first, machine.after(entry.get(r["_part"]), does)) if last is None else last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, state = None, None, None
        for b in batches:
            own = b.column("_part").to_numpy()
            for cut in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(own)) + 1) if b.num_rows else ():
                c = b.slice(int(cut[0]), len(cut))
                for key_here, at in _pieces(c):
                    if part != own[cut[0]]:
                        part, k, state = own[cut[0]], key_here, entry.get(int(own[cut[0]]))
                    elif key_here != k:
                        k, state = key_here, None
                    state, keep, more = machine.step(state, _rows(c, machine, at))
                    rows = c.slice(at.start, at.stop - at.start).select(names)
                    rows = pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(more[a], pa.float64(), from_pandas=True) for a in machine.adds]], [*names, *machine.adds])
                    yield rows if keep is None else rows.filter(pa.array(keep))

    out = T.StructType([*nullable[:len(names)], *[T.StructField(a, T.DoubleType()) for a in machine.adds]])
    rows = held.where("_summary is null").drop("_summary").repartitionByRange(parts, "_part").sortWithinPartitions("_part", "_at")
    return rows.mapInArrow(run, out)
