"""Clusters and their representatives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismview.functions.shared import discard, importable, ranked, scratch, settled

#: Centres that are sent to every task at most (with 1,000 dimensions 512 MB).
MOST_CENTERS = 1 << 16


def kmeans(df: DataFrame, features: list[str], k: int, row_id: str, seed: int = 1, iterations: int = 20) -> DataFrame:
    """row_id, cluster (empty ones dropped, renumbered from 0), dist, rank within the cluster; complete rows only."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector, vector_to_array  # noqa: F401

    v = VectorAssembler(inputCols=features, outputCol="_v").transform(df.dropna(subset=features))
    model = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="_v", predictionCol="_c").fit(v)
    centers = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "_c int, _m array<double>")
    d = model.transform(v).join(F.broadcast(centers), "_c")  # k rows
    sq = F.aggregate(F.zip_with(vector_to_array("_v"), "_m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    used = model.transform(v).groupBy("_c").count().select("_c", (F.row_number().over(Window.orderBy("_c")) - 1).alias("cluster"))
    out = d.withColumn("dist", F.sqrt(sq)).join(F.broadcast(used), "_c").select(row_id, "cluster", "dist")
    return ranked_in_cluster(out, row_id)


#: Rows that a partition of a batch offers as new places for starved centres.
SPARE = 16
#: Centres that move after a pass, at most.
MOVES = 1 << 10
#: Distances of a block, which stays in a core's cache.
BLOCK = 1 << 17
#: Rows of a file of a batch, about; a task reads one or a few.
PIECE = 1 << 14


def _nearest(v: np.ndarray, at: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its squared distance, by products of blocks of rows with all centres (1 MB a block, or a row)."""
    which, far = np.empty(len(v), dtype=np.int64), np.empty(len(v))
    step = max(1, BLOCK // len(at))
    for lo in range(0, len(v), step):
        x = v[lo:lo + step]
        d = x @ at.T
        d *= -2
        d += norms
        which[lo:lo + step] = i = d.argmin(axis=1)
        far[lo:lo + step] = np.maximum(d[np.arange(len(x)), i] + (x * x).sum(axis=1), 0.0)
    return which, far


def _exactly_nearest(v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the first of equally near ones, and its squared distance, without the rounding of ``_nearest``: all centres that
    products leave within their rounding of the least are measured by differences."""
    norms, which, dist = (at * at).sum(axis=1), np.empty(len(v), dtype=np.int64), np.empty(len(v))
    step = max(1, BLOCK // len(at))
    for lo in range(0, len(v), step):
        x = v[lo:lo + step]
        d = x @ at.T
        d *= -2
        d += norms
        slack = 1e-15 * (at.shape[1] + 8) * ((x * x).sum(axis=1) + norms.max())
        row, c = np.nonzero(~(d > (d.min(axis=1) + slack)[:, None]))
        far = ((x[row] - at[c]) ** 2).sum(axis=1)
        first = np.lexsort((c, far, row))
        first = first[np.flatnonzero(np.diff(row[first], prepend=-1))]
        which[lo:lo + step], dist[lo:lo + step] = c[first], far[first]
    return which, dist


def _batch_sums(rows: DataFrame, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[float, tuple[float, ...]]], float]:
    """Of a batch (_v): members and vector sums of each centre, the farthest rows with their distances (a few a partition), and the sum of squared distances.

    A partition sends one row per centre it met, so what is shuffled and what the driver gets grows with the centres, not with the rows.
    """
    k, width = at.shape
    held = rows.sparkSession.sparkContext.broadcast((at, (at * at).sum(axis=1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, norms = held.value
        n, sums, total, spare = np.zeros(len(centers)), np.zeros(centers.shape), 0.0, []
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
            which, far = _nearest(v, centers, norms)
            n += np.bincount(which, minlength=len(centers))
            order = np.argsort(which, kind="stable")
            first = np.flatnonzero(np.diff(which[order], prepend=-1))
            sums[which[order][first]] += np.add.reduceat(v[order], first, axis=0)
            total += far.sum()
            spare += [(float(far[i]), v[i]) for i in np.argsort(-far, kind="stable")[:SPARE]]
            spare = sorted(spare, key=lambda x: -x[0])[:SPARE]
        some = np.flatnonzero(n)
        kinds = [*some, *[-1] * len(spare), *([-2] if len(some) else [])]
        numbers = [*n[some], *[x[0] for x in spare], *([total] if len(some) else [])]
        vectors = [*sums[some], *[x[1] for x in spare], *([np.zeros(centers.shape[1])] if len(some) else [])]
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(numbers, pa.float64()), pa.array(vectors, pa.list_(pa.float64()))], ["cluster", "n", "s"])

    # each of the farthest rows stays a row: it is told apart by its distance
    part = rows.select("_v").mapInArrow(run, "cluster int, n double, s array<double>")
    got = part.groupBy("cluster", F.when(F.col("cluster") == -1, F.col("n")).alias("far")).agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(width)]).alias("s")).collect()
    held.unpersist()
    n, sums, total = np.zeros(k), np.zeros(at.shape), 0.0
    spare = [(r["far"], tuple(r["s"])) for r in got if r["cluster"] == -1 and r["n"] == r["far"]]
    for r in got:
        if r["cluster"] >= 0:
            n[r["cluster"]], sums[r["cluster"]] = r["n"], r["s"]
        elif r["cluster"] == -2:
            total = r["n"]
    return n, sums, spare, total


def _reseeded(at: np.ndarray, weight: np.ndarray, members: np.ndarray, spare: list[tuple[float, tuple[float, ...]]]) -> None:
    """Move centres that are starved to the farthest rows, in place.

    Without a centre its rows would go to the next one, at a cost of about their number times the squared distance of the two. It moves where
    a far row's squared distance is more than that. A centre that takes another's rows stays, and rows near a row that has got a centre don't count again.
    """
    norms = (at * at).sum(axis=1)
    poor = np.argsort(members, kind="stable")[:MOVES]
    d = np.maximum(norms[poor, None] - 2 * (at[poor] @ at.T) + norms, 0.0)
    d[np.arange(len(poor)), poor] = np.inf
    heir = d.argmin(axis=1)
    cost = members[poor] * np.where(np.isfinite(d.min(axis=1)), d.min(axis=1), np.inf) if len(at) > 1 else np.full(len(poor), np.inf)
    far, rows = np.array([x for x, _ in spare]), np.array([x for _, x in spare]).reshape(len(spare), -1)
    kept, gone = set(), set()
    for i in np.argsort(cost, kind="stable"):
        if not len(far) or far.max() <= cost[i]:
            break
        c = int(poor[i])
        if c in kept or int(heir[i]) in gone:
            continue
        best = int(far.argmax())
        at[c], weight[c] = rows[best], 0.0
        gone.add(c)
        kept.add(int(heir[i]))
        far = np.minimum(far, ((rows - rows[best]) ** 2).sum(axis=1))


def _by_turns(rows: DataFrame, turns: int, pieces: int) -> tuple[DataFrame, str]:
    """rows (_at, _v) with _turn, the range of _at out of ``turns`` equal ones, written by it in about so many pieces each; and where."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    u = F.col("_at").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned; floor(u * turns / 2 ** 64) by its halves
    high = F.shiftrightunsigned(u, 32) * turns + F.shiftrightunsigned(u.bitwiseAND(F.lit((1 << 32) - 1)) * turns, 32)
    rows = rows.withColumn("_turn", F.shiftrightunsigned(high, 32).cast("int"))
    path = scratch(spark, "permuted")
    place = F.col("_turn").cast("long") * pieces + F.pmod("_at", F.lit(pieces))  # pieces are dealt in turn, so a range's lie in as many partitions
    rows.repartitionById(parts, F.pmod(place, F.lit(parts)).cast("int")).write.partitionBy("_turn").parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


def minibatch_kmeans(df: DataFrame, features: list[str] | str, k: int, row_id: str, batch: int = 1 << 18, passes: int = 6, seed: int = 1) -> DataFrame:
    """cluster, center (array), members (rows of the last pass): k-means with up to ``MOST_CENTERS`` centres, by mini-batches.

    features: numeric columns, or one column of arrays of equal length. Rows with a missing feature are left out. The rows are put into
    a seeded order by a hash, written by ranges of it of about ``batch`` rows, and read range by range; each of the ``passes`` meets all rows once.
    A range lies in several files, so that all tasks share it, whatever the size of the table.
    A centre moves to the mean of all rows it has been given, with less weight on earlier passes (they are halved). After a pass but
    the last two, starved centres move (``_reseeded``). It starts with the
    first k different rows of the order, so fewer rows than centres give a centre per different row. The same table, seed and
    sizes give the same centres up to the rounding of sums.
    """
    if not 0 < k <= MOST_CENTERS:
        raise ValueError(f"from 1 to {MOST_CENTERS} centres")
    spark = df.sparkSession
    importable(spark)
    v = F.col(features) if isinstance(features, str) else F.array(*[F.col(c) for c in features])
    v = F.transform(v, lambda x: x.cast("double"))
    rows = df.select(F.xxhash64(F.lit(seed), row_id, v).alias("_at"), v.alias("_v"))
    rows = rows.where(F.col("_v").isNotNull() & F.forall("_v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))))
    turns = max(1, -(-rows.count() // batch))
    rows, path = _by_turns(rows, turns, -(-batch // PIECE))
    start, read = [], 1
    while len(start) < k:  # the first different rows are the centres; mostly they are all in the first range
        start = rows.where(F.col("_turn") < read).groupBy("_v").agg(F.min("_at").alias("_at")).orderBy("_at", "_v").limit(k).collect()
        if read >= turns:
            break
        read *= 4
    schema = "cluster int, center array<double>, members long"
    if not start:
        discard(path)
        return spark.createDataFrame([], schema)
    at = np.array([r["_v"] for r in start])
    weight, members = np.zeros(len(at)), np.zeros(len(at))
    for p in range(passes):
        weight, members, spare = weight / 2 if turns > 1 else weight * 0, members * 0, []
        for turn in range(turns):
            n, sums, far, _ = _batch_sums(rows.where(F.col("_turn") == turn), at)
            weight, members = weight + n, members + n
            hit = n > 0
            at[hit] += (sums[hit] - n[hit, None] * at[hit]) / weight[hit, None]
            spare = sorted(spare + far, reverse=True)[:MOVES]
        if p < passes - 2:
            _reseeded(at, weight, members, spare)
    discard(path)
    return spark.createDataFrame([(i, c.tolist(), int(m)) for i, (c, m) in enumerate(zip(at, members, strict=True))], schema)


def assign(df: DataFrame, vector: str, centers: DataFrame, row_id: str) -> DataFrame:
    """row_id, cluster, dist (squared) for given centres (cluster, center), MOST_CENTERS at most: one matrix is sent to every task. The
    lower cluster number wins a tie; a null vector has no cluster."""
    spark = df.sparkSession
    rows = sorted(centers.select("cluster", "center").limit(MOST_CENTERS + 1).collect(), key=lambda r: r["cluster"])
    if len(rows) > MOST_CENTERS:
        raise ValueError(f"over {MOST_CENTERS} centres")
    importable(spark)
    held = spark.sparkContext.broadcast((np.array([r["cluster"] for r in rows]), np.array([r["center"] for r in rows], dtype=float)))

    @F.pandas_udf("cluster int, dist double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        numbers, at = held.value
        out = pd.DataFrame({"cluster": pd.array([None] * len(vectors), dtype="Int32"), "dist": np.nan})
        some = np.flatnonzero(vectors.notna().to_numpy())
        if len(some) and len(at):
            which, dist = _exactly_nearest(np.stack(vectors.iloc[some].to_numpy()).astype(float), at)
            out.iloc[some, 0], out.iloc[some, 1] = numbers[which], dist
        return out

    return df.select(row_id, nearest(vector).alias("b")).select(row_id, F.col("b.cluster").alias("cluster"), F.col("b.dist").alias("dist"))


def ranked_in_cluster(df: DataFrame, row_id: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("dist", row_id)))


def size_percentiles(df: DataFrame) -> DataFrame:
    """One row: clusters, and the least, 5 %, median, 95 % and largest number of members."""
    n = df.groupBy("cluster").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("clusters"), F.min("n").alias("least"), *[F.percentile("n", p).alias(f"p{round(100 * p)}") for p in (0.05, 0.5, 0.95)], F.max("n").alias("most"))


def places(df: DataFrame, chosen: DataFrame, row_id: str, order: list[str]) -> DataFrame:
    """df with ``place``: where the row stands among the chosen ones in their order, -1 for the others."""
    listed = ranked(chosen, [F.col(c) for c in order], "_place", "chosen").select(F.col(row_id).alias("_chosen"), "_place")
    return df.join(listed, df[row_id] == listed["_chosen"], "left").withColumn("place", F.coalesce("_place", F.lit(-1).cast("long"))).drop("_chosen", "_place")


def first_fit(df: DataFrame, local: Column, near: int = 5, slack: float = 1.5) -> DataFrame:
    """One row per cluster: among the ``near`` nearest a local one within slack times the nearest distance, else the nearest."""
    c = df.where(F.col("rank") <= near).withColumn("_d0", F.min("dist").over(Window.partitionBy("cluster")))
    ok = local & (F.col("dist") <= slack * F.col("_d0"))
    return c.withColumn("_o", F.row_number().over(Window.partitionBy("cluster").orderBy(F.when(ok, 0).otherwise(1), "rank"))).where("_o = 1").drop("_o", "_d0")


def representatives(df: DataFrame, row_id: str, passes, rounds: int = 25) -> DataFrame:
    """Best-ranked member of each cluster that passes a test on rows; a cluster whose members all fail has none.

    passes: function from a DataFrame of candidates to those that pass. Each round tests one candidate per cluster, so no
    more rows are tested than need be.
    """
    left, done = df, None
    for k in range(rounds):
        head = left.withColumn("_h", F.row_number().over(Window.partitionBy("cluster").orderBy("rank"))).where("_h = 1").drop("_h")
        good = settled(passes(head), f"representatives-{k}")
        done = good if done is None else done.unionByName(good)
        left = settled(left.join(head.select(row_id), row_id, "left_anti").join(good.select("cluster"), "cluster", "left_anti"), f"candidates-{k}")
        if left.limit(1).count() == 0:
            break
    return done


def first_rule(rules: list[tuple[str, Column]], default: str = "ok") -> Column:
    """The name of the first rule that holds."""
    out = F.lit(default)
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out
