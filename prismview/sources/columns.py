"""Column files: a dimension as blocks of byte-shuffled, gzipped 16-bit codes, for readers that aren't Spark.

Parquet is the table format; these files are an export. Every task writes the blocks of its own rows, named by their first
rank, so no column passes through one place.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismview.functions.scalars import quantized
from prismview.functions.shared import importable

BLOCK = 65_536


def shuffled(codes: np.ndarray) -> bytes:
    """Low bytes, then high bytes."""
    return np.asarray(codes, dtype="<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def unshuffled(data: bytes, n: int) -> np.ndarray:
    if len(data) != 2 * n:
        raise ValueError(f"{len(data)} bytes for {n} codes")
    return np.frombuffer(data, dtype=np.uint8).reshape(2, n).T.copy().view("<u2").ravel()


def packed(data: bytes) -> bytes:
    """Gzip without a time, so that equal columns give equal bytes."""
    return gzip.compress(data, 9, mtime=0)


def unpacked(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def write_columns(df: DataFrame, rank: str, ranges: dict[str, tuple[float, float]], to: str, block: int = BLOCK) -> DataFrame:
    """Files to/<dim>-<block>.bin.gz; returns dim, block, rows, bytes. rank: 0, 1, 2, ... without gaps."""
    importable(df.sparkSession)
    dims = list(ranges)
    coded = df.select(F.floor(F.col(rank) / block).cast("long").alias("block"), F.col(rank).alias("rank"), *[quantized(F.col(d), *ranges[d]).alias(d) for d in dims])

    def write(table: pa.Table) -> pa.Table:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(to)
        files.create_dir(base, recursive=True)
        table, k = table.sort_by("rank"), table.column("block")[0].as_py()
        out = []
        for d in dims:
            data = packed(shuffled(table.column(d).to_numpy()))
            with files.open_output_stream(f"{base}/{d}-{k:08d}.bin.gz", compression=None) as f:
                f.write(data)
            out.append((d, k, table.num_rows, len(data)))
        return pa.table({n: [r[i] for r in out] for i, n in enumerate(("dim", "block", "rows", "bytes"))}, schema=pa.schema([("dim", pa.string()), ("block", pa.int64()), ("rows", pa.int64()), ("bytes", pa.int64())]))

    return coded.groupBy("block").applyInArrow(write, "dim string, block long, rows long, bytes long")  # a block is bounded


def read_column(spark: SparkSession, path: str, dim: str, lo: float, hi: float, block: int = BLOCK) -> DataFrame:
    """rank, value of a dimension's files; missing values are null."""
    importable(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = unpacked(content)
                codes = unshuffled(raw, len(raw) // 2).astype(np.int64)
                k = int(name.rsplit("-", 1)[1].split(".")[0])
                value = pa.array(lo + (codes - 1) * ((hi - lo) / 65534), mask=codes == 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(codes)) + k * block), value], ["rank", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{dim}-*.bin.gz").load(path).select("path", "content")
    return files.mapInArrow(parse, "rank long, value double")
