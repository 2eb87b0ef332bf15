"""Shared scratch storage and distributed row numbers."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_local: dict[str, str] = {}  # application: its folder, where no shared one is set
_open: dict[str, object] = {}  # path of each scratch folder that still exists: the file system's handle
_tables: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # written table: its path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Python workers that start from now on find this package where the driver has it (a cluster installs it on every node)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it isn't set, a local master (driver and
    executors are one process) gets a temporary folder; on a cluster that would lose rows, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="prismview-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        base = "file://" + _local[app]
    if "://" not in base:  # a path of the default file system, which tasks should find as well
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        base = base.replace("file:/", "file:///", 1) if not base.startswith("file://") else base
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what lies there is removed by ``discard`` or at the end of the driver's process."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    handle = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _open[path] = handle, handle.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path


def discard(path: str) -> None:
    handle = _open.pop(path, None)
    if handle:
        handle[1].delete(handle[0], True)


@atexit.register
def _discard_all() -> None:
    with contextlib.suppress(Exception):  # the gateway may be gone by now
        for path in list(_open):
            discard(path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int | None):
    """Arrow batches of so many rows at most, for what is run inside."""
    before = spark.conf.get(ARROW_ROWS)
    if rows:
        importable(spark)
        spark.conf.set(ARROW_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def settled(df: DataFrame, name: str, *done: DataFrame, rows: int | None = None) -> DataFrame:
    """df written once to the shared folder and read back: its lineage ends there, so a lost executor costs no recomputation.

    done: written tables that nothing else reads from now on; they are removed. rows: the size of Arrow batches, for plans
    whose Python functions take whole texts.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with arrow_rows(spark, rows):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[out] = path
    forget(*done)
    return out


def forget(*done: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for table in done:
        path = _tables.pop(table, None)
        if path:
            discard(path)


#: Rows of a partition that ``dealt`` aims at.
DEALT = 1 << 20


def dealt(df: DataFrame, keys: list[str], rows: int = DEALT) -> DataFrame:
    """df dealt by its keys into partitions of about so many rows, as many as the input needs (the session's number at least): what a task sorts
    doesn't grow with the table. df's rows are counted."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-df.count() // rows))
    return df.repartition(parts, *keys)


def ranked(df: DataFrame, keys: list[Column], rank: str, name: str = "rank") -> DataFrame:
    """df with ``rank``: 0, 1, 2, ... in the order of keys over all rows, without any single-task sort.

    Rows are range-partitioned and sorted, written, and numbered inside each partition; the only thing that
    meets on the driver is one count per partition. Rows with equal keys take the order of a row number, so hot
    values spread over partitions.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    keys = [*keys, F.col("_row")]
    held = (df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_row")
            .withColumn("_part", F.spark_partition_id())
            .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    held = settled(held, name)
    counts = sorted((r["_part"], r["n"]) for r in held.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, count in counts:
        before.append((part, total))
        total += count
    starts = spark.createDataFrame(before or [(0, 0)], "_part int, _before long")
    return (held.join(F.broadcast(starts), "_part")  # a row for each partition
            .withColumn(rank, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before"))


#: Values whose quantiles one task may work out from a map of them; more are range-sorted.
IN_A_TASK = 1 << 20


def quantiles(df: DataFrame, column: str, ps: list[float], most: int = IN_A_TASK) -> list[float | None]:
    """Exact quantiles (type 7) of a column of doubles over all rows, null values left out; nulls if there are none.

    Up to ``most`` values are one aggregate. More are sorted by range, and only the order statistics next to the quantiles'
    places reach the driver, so no task holds more than its range. df should be a written table: it is read twice.
    """
    v = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n = v.count()
    if n <= most:
        return list(v.agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in ps])).alias("q")).first()["q"] or [None] * len(ps))
    places = [p * (n - 1) for p in ps]
    wanted = sorted({k for x in places for k in (int(x), min(int(x) + 1, n - 1))})
    held = ranked(v, [F.col("v")], "at", "quantiles")
    at = {r["at"]: r["v"] for r in held.where(F.col("at").isin(wanted)).collect()}  # two rows a quantile
    return [at[int(x)] + (at[min(int(x) + 1, n - 1)] - at[int(x)]) * (x - int(x)) for x in places]
