"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismview.functions.shared import IN_A_TASK, settled

#: Order statistics that are sent to all tasks at once, at most; more are joined by a shuffle.
SENT = 1 << 18


#: Names of the columns of a table of value counts.
VALUE, COUNT = "_value", "_count"


def value_counts(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """keys, _value, _count, written: the different values of each group with their numbers (or sums of ``weight``, a whole number).

    Equal values are combined before the shuffle; a value that a third of all rows have is one row from then on. Null values are
    left out, null keys are a group; without keys the whole table is one, under the key _all.
    """
    own = [F.col(f"`{k}`") for k in keys] or [F.lit(0).alias("_all")]
    named = df.select(*own, F.col(f"`{value}`").cast("double").alias(VALUE), (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias(COUNT))
    return settled(named.where(f"{VALUE} is not null").groupBy(*named.columns[:-1]).agg(F.sum(COUNT).alias(COUNT)), "value-counts")


def largest_group(counts: DataFrame) -> int:
    """Different values of the group that has the most of them."""
    return counts.groupBy(*counts.columns[:-2]).agg(F.count("*").alias("several")).agg(F.max("several")).first()[0] or 0


def quantiles_of(counts: DataFrame, ps: list[float], most: int = IN_A_TASK, largest: int | None = None) -> DataFrame:
    """keys, n (values present), q: the exact quantiles (type 7) at ps, as an array, of every group of value_counts.

    Groups of up to ``most`` different values are an aggregate each. The others are range-sorted together by (keys, value): a group
    may lie in many partitions, and a partition may hold many groups. The rows that each partition has of a group say in which one
    an order statistic lies, and at which running count. So no task holds more than its range, and one scan of the sorted
    table picks what is wanted of all groups.

    largest: ``largest_group`` of counts, where that is known. counts with groups beyond ``most`` should be a written table.
    """
    keys = counts.columns[:-2]
    small, large = counts, None
    if (largest_group(counts) if largest is None else largest) > most:
        sizes = counts.groupBy(*keys).agg(F.count("*").alias("several"), F.sum(COUNT).alias("n"))
        sizes = settled(sizes.where(F.col("several") > most), "group-sizes")
        these = sizes.select(*[F.col(x).alias(f"_key_{x}") for x in keys]).hint("shuffle_hash")  # a row for each large group
        large = _sorted_quantiles(counts.join(these, _same(counts, these, keys), "left_semi"), keys, sizes, ps)
        small = counts.join(these, _same(counts, these, keys), "left_anti")
    found = small.groupBy(*keys).agg(F.sum(COUNT).alias("n"), F.percentile(VALUE, F.array(*[F.lit(float(p)) for p in ps]), F.col(COUNT)).alias("q"))
    return found if large is None else found.union(large)


def group_quantiles(df: DataFrame, keys: list[str], value: str, ps: list[float], most: int = IN_A_TASK) -> DataFrame:
    """keys, n, q: ``quantiles_of`` the values of each group of df."""
    return quantiles_of(value_counts(df, keys, value), ps, most).drop("_all")


def group_median(df: DataFrame, keys: list[str], value: str, name: str = "mid", most: int = IN_A_TASK) -> DataFrame:
    """keys, n, name: the exact median of each group with a value."""
    return group_quantiles(df, keys, value, [0.5], most).select(*keys, "n", F.get("q", F.lit(0)).alias(name))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """a's keys are those that b has under names with a leading _key_."""
    return reduce(Column.__and__, [a[x].eqNullSafe(b[f"_key_{x}"]) for x in keys])


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows with the running sum of their last column, the count."""
    total = 0
    for b in batches:
        upto = total + np.cumsum(b.column(b.num_columns - 1).to_numpy())
        total = int(upto[-1]) if len(upto) else total
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto, pa.int64())], [*b.schema.names, "_upto"])


def _sorted_quantiles(counts: DataFrame, keys: list[str], sizes: DataFrame, ps: list[float]) -> DataFrame:
    """keys, n, q of the groups of value counts; sizes: keys, n."""
    parts = max(1, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    order = counts.repartitionByRange(parts, *keys, VALUE).sortWithinPartitions(*keys, VALUE).select(*keys, VALUE, F.spark_partition_id().alias("_range"), COUNT)
    order = settled(order.mapInArrow(_running, T.StructType([*order.schema, T.StructField("_upto", T.LongType())])), "sorted-values")
    sizes = sizes.select(*[F.col(x).alias(f"_key_{x}") for x in keys], "n")
    # what a partition has of a group: as many rows as there are partitions and groups
    runs = order.groupBy("_range", *keys).agg(F.min(F.col("_upto") - F.col(COUNT)).alias("_first"), F.sum(COUNT).alias("_m"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_m").over(earlier), F.lit(0)))
    ps = F.array(*[F.lit(float(p)) for p in ps])
    at = F.transform(ps, lambda p: p * (F.col("n") - 1))
    places = F.array_distinct(F.concat(F.transform(at, lambda x: F.floor(x)), F.transform(at, lambda x: F.ceil(x))))
    here = F.filter(places, lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("_m")))
    targets = F.transform(here, lambda k: F.struct(k.alias("place"), (k - F.col("_before") + F.col("_first")).alias("at")))
    asked = runs.join(sizes, _same(runs, sizes, keys)).select(F.col("_range").alias("_of_range"), *[f"_key_{x}" for x in keys], targets.alias("targets"))
    asked = settled(asked.where(F.size("targets") > 0), "order-statistics")
    few = (asked.agg(F.sum(F.size("targets"))).first()[0] or 0) <= SENT
    met = order.join(F.broadcast(asked) if few else asked, (F.col("_range") == F.col("_of_range")) & _same(order, asked, keys))
    hits = F.filter("targets", lambda x: (x["at"] >= F.col("_upto") - F.col(COUNT)) & (x["at"] < F.col("_upto")))
    found = met.select(*keys, VALUE, F.explode(F.transform(hits, lambda x: x["place"])).alias("_place"))
    found = settled(found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_place", VALUE))).alias("_held")), "order-values", order, asked)

    def between(x: Column) -> Column:
        a, b = F.element_at("_held", F.floor(x)), F.element_at("_held", F.ceil(x))
        return F.when(a == b, a).otherwise((F.ceil(x) - x) * a + (x - F.floor(x)) * b)

    return found.join(sizes, _same(found, sizes, keys)).select(*keys, "n", F.transform(at, between).alias("q"))
