"""Readers with explicit schemas: delimited and irregular text, chunked CSV, listings, JSON with defaults."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def spaced_text(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """White-space delimited text with # comments. strict: a line with another number of fields is an error; otherwise it is
    left out. Values that don't parse become null."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    parts = F.split("v", r"\s+")
    d = lines.select(parts.alias("p"))
    if strict:
        d = d.withColumn("p", F.when(F.size("p") == len(schema), F.col("p")).otherwise(F.raise_error(F.concat(F.lit(f"expected {len(schema)} fields: "), F.array_join("p", " ")))))
    else:
        d = d.where(F.size("p") == len(schema))
    return d.select(*[F.get("p", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema)])


def irregular_text(spark: SparkSession, path: str, schema: T.StructType, tail: str = "note") -> tuple[DataFrame, DataFrame]:
    """Leading typed fields and a free-text tail: (good rows, one row with n_bad). A row is bad if a typed field doesn't parse."""
    n = len(schema)
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    parts = F.split(F.trim("value"), r"\s+", n + 1)
    d = lines.select(parts.alias("p"))
    d = d.select(*[F.get("p", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema)], F.coalesce(F.get("p", F.lit(n)), F.lit("")).alias(tail))
    bad = F.lit(False)
    for f in schema:
        bad = bad | F.col(f.name).isNull()
    return d.where(~bad), d.agg(F.count_if(bad).alias("n_bad"))


def csv_chunks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Gzip or plain CSV files with a header that must match the schema; ids that the schema declares as strings stay so."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def compiled_chunks(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], tag: str = "chunk") -> DataFrame:
    """All chunks with their file's name, one row per key: of repeats that from the file that sorts first."""
    d = csv_chunks(spark, path, schema).withColumn(tag, F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)(\.csv)?(\.gz)?$", 1))
    rest = [c for c in schema.names if c not in keys]
    w = Window.partitionBy(*keys).orderBy(tag, *rest)
    return d.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, name, bytes of the files in a folder; contents aren't read."""
    return spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


def binary_files(spark: SparkSession, path: str, base64: bool = False) -> DataFrame:
    """path, content; base64: the files hold base64 text."""
    d = spark.read.format("binaryFile").load(path)
    return d.select("path", (F.unbase64(F.col("content").cast("string")) if base64 else F.col("content")).alias("content"))


def json_or(path: str, default):
    """A small JSON sidecar, or default if it is missing or broken."""
    try:
        with open(path) as f:
            return json.load(f)
    except (OSError, ValueError):
        return default


def safe_base(given: str | None, default: str = "data") -> str:
    """A relative folder name without tricks, else the default."""
    import re

    return given if given and re.fullmatch(r"[A-Za-z0-9_\-]+(/[A-Za-z0-9_\-]+)*", given) else default


def tolerant_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns with their types; a column that df lacks is all null; more than half missing is an error."""
    missing = [c for c in wanted if c not in df.columns]
    if len(missing) * 2 > len(wanted):
        raise ValueError(f"too many columns are missing: {missing}")
    return df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in wanted.items()])


def key_ranges(keys: list[int], per: int = 30) -> list[tuple[int, int]]:
    """Closed ranges of ``per`` sorted distinct keys each: the pieces of a bounded key list for a remote source."""
    k = sorted(set(keys))
    return [(k[i], k[min(i + per, len(k)) - 1]) for i in range(0, len(k), per)]


def degree_ranges(lo: float, hi: float, step: float = 10.0) -> list[tuple[float, float | None]]:
    """Half-open slices; the last one has no upper end."""
    edges = []
    while lo < hi:
        edges.append(lo)
        lo += step
    return [(a, edges[i + 1] if i + 1 < len(edges) else None) for i, a in enumerate(edges)]


def cached(spark: SparkSession, path: str, sources: list[str], build) -> DataFrame:
    """A derived table that is built again only if a local source is newer than it."""
    local = path.removeprefix("file://")
    mark = os.path.join(local, "_SUCCESS")
    fresh = os.path.exists(mark) and all(os.path.getmtime(s.removeprefix("file://")) <= os.path.getmtime(mark) for s in sources)
    if not fresh:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def latex_rows(spark: SparkSession, path: str, pattern: str, columns: list[str]) -> DataFrame:
    """Rows of a LaTeX table whose lines match pattern: cells between &, numbers from math mode."""
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    cells = F.split(F.regexp_replace("value", r"\\\\.*$", ""), "&")
    number = lambda c: F.regexp_extract(F.regexp_replace(c, r"[{}$\s]", ""), r"[-+]?\d+(\.\d+)?", 0).try_cast("double")
    return lines.select(cells.alias("c")).where(F.size("c") == len(columns)).select(*[number(F.get("c", F.lit(i))).alias(n) for i, n in enumerate(columns)])


def synthetic(spark: SparkSession, n: int, seed: int = 20260924) -> DataFrame:
    """A correlated table with realistic gaps: id, mass, rate, color, size, class, lon, lat."""
    r = spark.range(n)
    m, e1, e2 = F.randn(seed), F.randn(seed + 1), F.randn(seed + 2)
    d = r.select("id", (10.5 + 0.6 * m).alias("mass"), e1.alias("e1"), e2.alias("e2"), F.rand(seed + 3).alias("u"), F.rand(seed + 4).alias("v"), (360 * F.rand(seed + 5)).alias("lon"), F.degrees(F.asin(2 * F.rand(seed + 6) - 1)).alias("lat"))
    red = F.col("u") < 1 / (1 + F.exp(-(F.col("mass") - 10.5) * 3))
    return d.select("id", "mass", F.when(F.col("v") > 0.05, F.when(red, F.col("mass") - 11.5).otherwise(0.7 * F.col("mass") - 7) + 0.3 * F.col("e1")).alias("rate"),
                    F.when(F.col("v") > 0.02, F.when(red, 0.75).otherwise(0.45) + 0.05 * F.col("e2")).alias("color"), (0.3 * F.col("mass") - 2.6 + 0.15 * F.col("e1")).alias("size"), F.when(red, 2).otherwise(1).alias("class"), "lon", "lat")
