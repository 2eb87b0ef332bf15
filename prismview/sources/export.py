"""Exports as transactions: column files and a manifest that either stands for all of them or isn't there.

``write_export`` writes a table, in the order of a rank, as blocks of columns: dimensions as byte-shuffled 16-bit codes, categories as
bytes, metadata as plain numbers less an offset. Every task writes the blocks of its own range into a folder of the transaction; the
commit puts the manifest together from what the tasks report (counts, hashes) and renames it into place, so a reader sees the old
export or the new one. A failed write removes its folder (``vacuum`` what late tasks leave).

The manifest's ``order`` is a hash of the keys in their order. Blocks that depend on the order (``blocks``) are carried over by a new export
only if its order is the same, and ``set_block`` refuses to add one that was made for another order. Changing a block changes nothing else: the
rest of the manifest is compared before it is renamed, and ``verified`` hashes all files again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from prismview.functions.scalars import decoded, quantized
from prismview.functions.shared import importable
from prismview.sources.acquire import file_system
from prismview.sources.columns import BLOCK, packed, shuffled, unpacked, unshuffled

MANIFEST = "manifest.json"
#: dtype of a metadata column -> NumPy's.
DTYPES = {"f32": "<f4", "f64": "<f8", "u8": "u1", "u16": "<u2", "u32": "<u4", "i32": "<i4"}


def _stored(values: pa.Array, spec: dict) -> bytes:
    """A block of a column: spec's kind is dim, cat or meta."""
    if spec["kind"] == "meta":
        kind = np.dtype(DTYPES[spec["dtype"]])
        if kind.kind != "f" and values.null_count:
            raise ValueError("a metadata column of whole numbers has nulls")
        x = values.fill_null(np.nan).to_numpy(zero_copy_only=False) if kind.kind == "f" else values.to_numpy(zero_copy_only=False)
        x = x - spec.get("offset", 0)
        out = x.astype(kind)
        if kind.kind != "f" and (out != x).any():
            raise ValueError(f"values beyond {spec['dtype']}")
        return out.tobytes()
    x = values.fill_null(0).to_numpy(zero_copy_only=False)
    return shuffled(x) if spec["kind"] == "dim" else x.astype(np.uint8).tobytes()


def _loaded(data: bytes, spec: dict) -> pa.Array:
    """Codes of a dim (0: missing), codes of a cat, values of a metadata column."""
    if spec["kind"] == "meta":
        x = np.frombuffer(data, dtype=DTYPES[spec["dtype"]]).astype(float) + spec.get("offset", 0)
        return pa.array(x, mask=np.isnan(x))
    return pa.array((unshuffled(data, len(data) // 2) if spec["kind"] == "dim" else np.frombuffer(data, np.uint8)).astype(float))


@dataclass
class _Wrote(WriterCommitMessage):
    """blocks: number -> (rows, hash of the keys, hash of each column's file); counts: of each category's codes."""

    blocks: dict[int, tuple[int, str, dict[str, str]]] = field(default_factory=dict)
    counts: dict[str, dict[int, int]] = field(default_factory=dict)


class ExportWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.block, self.columns = options["path"].rstrip("/"), int(options["block"]), json.loads(options["columns"])
        self.txn = options["transaction"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Wrote:
        out, held, number = _Wrote(), [], None
        for b in iterator:
            own = b.column("block").to_numpy()
            for cut in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(own)) + 1) if b.num_rows else ():
                if own[cut[0]] != number:
                    self._block(out, held, number)
                    held, number = [], own[cut[0]]
                held.append(b.slice(int(cut[0]), len(cut)))
        self._block(out, held, number)
        return out

    def _block(self, out: _Wrote, held: list[pa.RecordBatch], number) -> None:
        if not held:
            return
        t, (fs, base) = pa.Table.from_batches(held).combine_chunks(), file_system(f"{self.path}/{self.txn}")
        want = np.arange(t.num_rows) + int(number) * self.block
        if t.num_rows > self.block or (t.column("rank").to_numpy() != want).any():
            raise ValueError("the ranks have to be 0, 1, 2, ... without gaps")
        fs.create_dir(base, recursive=True)
        hashes = {}
        for name, spec in self.columns.items():
            data = packed(_stored(t.column(f"c_{name}").combine_chunks(), spec))
            with fs.open_output_stream(f"{base}/{name}-{int(number):08d}.bin.gz", compression=None) as f:
                f.write(data)
            hashes[name] = hashlib.sha1(data).hexdigest()
            if spec["kind"] == "cat":
                codes, n = np.unique(t.column(f"c_{name}").fill_null(0).to_numpy(), return_counts=True)
                mine = out.counts.setdefault(name, {})
                for c, k in zip(codes.tolist(), n.tolist(), strict=True):
                    mine[c] = mine.get(c, 0) + k
        out.blocks[int(number)] = t.num_rows, hashlib.sha1("\n".join(t.column("key").to_pylist()).encode()).hexdigest(), hashes

    def commit(self, messages: list[_Wrote | None]) -> None:
        blocks = dict(sorted((k, v) for m in messages if m for k, v in m.blocks.items()))
        full = [rows for rows, *_ in blocks.values()]
        if list(blocks) != list(range(len(blocks))) or any(n != self.block for n in full[:-1]):
            raise ValueError("the ranks have to be 0, 1, 2, ... without gaps")
        digest = lambda parts: hashlib.sha1("\n".join(parts).encode()).hexdigest()
        columns = {}
        for name, spec in self.columns.items():
            columns[name] = spec | {"sha1": digest(h[name] for _, _, h in blocks.values())}
            if spec["kind"] == "cat":
                n: dict[int, int] = {}
                for m in messages:
                    for c, k in (m.counts.get(name, {}) if m else {}).items():
                        n[c] = n.get(c, 0) + k
                columns[name] |= {"missing": n.get(0, 0), "counts": [n.get(c, 0) for c in range(1, max([*n, 0]) + 1)]}
        new = {"n": sum(full), "block": self.block, "folder": self.txn, "order": digest(h for _, h, _ in blocks.values()), "columns": columns, "blocks": {}}
        old = _read(self.path)
        if old and old["order"] == new["order"]:
            new["blocks"] = old["blocks"]
        _replace(self.path, new)
        if old:
            fs, base = file_system(f"{self.path}/{old['folder']}")
            fs.delete_dir(base)

    def abort(self, messages: list[_Wrote | None]) -> None:
        from pyarrow.fs import FileType

        fs, base = file_system(f"{self.path}/{self.txn}")
        if fs.get_file_info(base).type == FileType.Directory:
            fs.delete_dir(base)


class ExportSource(DataSource):
    """write.format("column_export"): options path, block, columns (JSON), transaction."""

    @classmethod
    def name(cls) -> str:
        return "column_export"

    def writer(self, schema, overwrite: bool) -> ExportWriter:
        return ExportWriter(self.options)


def _read(path: str) -> dict | None:
    fs, base = file_system(path)
    from pyarrow.fs import FileType

    if fs.get_file_info(f"{base}/{MANIFEST}").type != FileType.File:
        return None
    with fs.open_input_stream(f"{base}/{MANIFEST}", compression=None) as f:
        return json.loads(f.read())


def _replace(path: str, manifest: dict) -> None:
    """The manifest under another name first, read back, then renamed."""
    fs, base = file_system(path)
    other = f"{base}/.{MANIFEST}.{uuid.uuid4().hex}"
    with fs.open_output_stream(other, compression=None) as f:
        f.write(json.dumps(manifest, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode())
    with fs.open_input_stream(other, compression=None) as f:
        if json.loads(f.read()) != manifest:
            raise ValueError("the manifest wasn't written as it is")
    fs.move(other, f"{base}/{MANIFEST}")


def manifest(path: str) -> dict:
    """The manifest of an export, its shape checked."""
    m = _read(path)
    ok = isinstance(m, dict) and isinstance(m.get("columns"), dict) and isinstance(m.get("n"), int) and m["n"] > 0 and isinstance(m.get("blocks"), dict)
    if not ok or not all(isinstance(c, dict) and c.get("kind") in ("dim", "cat", "meta") for c in m["columns"].values()):
        raise ValueError(f"no export in {path}, or a malformed manifest")
    return m


def write_export(df: DataFrame, rank: str, key: str, to: str, dims: dict[str, tuple[float, float]], cats: dict[str, list[str]] | None = None, meta: dict[str, dict] | None = None, block: int = BLOCK) -> dict:
    """Export df, and give the manifest. rank: 0, 1, 2, ... without gaps; key: what the order is the order of; dims: closed ranges; cats: labels of
    the codes 1, 2, ... (a missing code is 0); meta: {"dtype": .., "offset": ..}."""
    importable(df.sparkSession)
    df.sparkSession.dataSource.register(ExportSource)
    columns = {k: {"kind": "dim", "min": lo, "max": hi} for k, (lo, hi) in dims.items()} | {k: {"kind": "cat", "labels": v} for k, v in (cats or {}).items()} | {k: {"kind": "meta"} | v for k, v in (meta or {}).items()}
    as_stored = {"dim": lambda k: quantized(F.col(k), *dims[k]), "cat": lambda k: F.coalesce(F.col(k), F.lit(0)).cast("int"), "meta": lambda k: F.col(k).cast("double")}
    coded = df.select(F.floor(F.col(rank) / block).cast("long").alias("block"), F.col(rank).cast("long").alias("rank"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), *[as_stored[c["kind"]](k).alias(f"c_{k}") for k, c in columns.items()])
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    options = {"path": to, "block": block, "columns": json.dumps(columns), "transaction": f"v-{uuid.uuid4().hex[:12]}"}
    coded.repartitionByRange(parts, "block").sortWithinPartitions("rank").write.format("column_export").options(**options).mode("append").save()
    return manifest(to)


def vacuum(path: str) -> list[str]:
    """Remove what failed or was replaced: all folders of transactions but the manifest's. A task that still runs when its job has failed may leave
    one; no export may be under way."""
    from pyarrow.fs import FileSelector

    m, (fs, base) = _read(path), file_system(path)
    old = [f.base_name for f in fs.get_file_info(FileSelector(base, allow_not_found=True)) if f.base_name.startswith("v-") and not (m and f.base_name == m["folder"])]
    for name in old:
        fs.delete_dir(f"{base}/{name}")
    return old


def _files(spark: SparkSession, path: str, m: dict, name: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", f"{name}-*.bin.gz").load(f"{path.rstrip('/')}/{m['folder']}").select("path", "content")


def read_export(spark: SparkSession, path: str, name: str) -> DataFrame:
    """rank, value of one column; nothing is read before it is used, and no other column's files are."""
    importable(spark)
    m = manifest(path)
    spec, block, n = m["columns"][name], m["block"], m["n"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                first = int(file.rsplit("-", 1)[1].split(".")[0]) * block
                values = _loaded(unpacked(content), spec)
                if len(values) != min(block, n - first):
                    raise ValueError(f"{file}: {len(values)} values, expected {min(block, n - first)}")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)) + first), values], ["rank", "code"])

    rows, code = _files(spark, path, m, name).mapInArrow(parse, "rank long, code double"), F.col("code")
    value = decoded(code, spec["min"], spec["max"]) if spec["kind"] == "dim" else code.cast("int") if spec["kind"] == "cat" else code
    return rows.select("rank", value.alias("value"))


def verified(spark: SparkSession, path: str) -> DataFrame:
    """name, files, ok of every column: whether its files are those that the manifest was written for."""
    m = manifest(path)
    out = []
    for name, spec in m["columns"].items():
        hashes = F.array_sort(F.collect_list(F.struct("path", F.sha1("content").alias("h"))))  # forty characters a block
        got = _files(spark, path, m, name).agg(F.count("*").alias("files"), F.sha1(F.array_join(F.transform(hashes, lambda x: x["h"]), "\n")).alias("sha1"))
        out.append(got.select(F.lit(name).alias("name"), "files", (F.col("sha1") == spec["sha1"]).alias("ok")))
    from functools import reduce

    return reduce(DataFrame.unionByName, out)


def set_block(path: str, name: str, value: dict | None, order: str) -> dict:
    """Put a dependent block into the manifest (None: take it out) and change nothing else; refused if it was made for another order."""
    m = manifest(path)
    if m["order"] != order:
        raise ValueError(f"block {name} was made for another order of rows")
    new = m | {"blocks": {k: v for k, v in m["blocks"].items() if k != name} | ({} if value is None else {name: value})}
    if {k: v for k, v in new.items() if k != "blocks"} != {k: v for k, v in _read(path).items() if k != "blocks"}:
        raise ValueError("the export changed meanwhile")
    _replace(path, new)
    return new
