"""Nearest rows within a limit, in the plane, in space or on the sphere, whatever the rows' clusters look like.

Rows lie in a tree of cells: squares or cubes of about the limit's size, and wherever a cell holds more than ``load`` different
positions, it is halved along each axis, again and again. A query starts from the cells around its own and goes down level by level; a
cell that can't hold the nearest row, since another one surely holds a nearer one, is dropped. So a query meets a few leaves of
``load`` positions each, also where a million rows lie within its limit. Equal positions count once, on either side: of the rows
the one with the smallest id stands for them.

All steps are equi-joins on cells and groups by query; the loops are over levels (halvings of the limit), never over rows.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismview.functions.scalars import unit_vector
from prismview.functions.shared import settled

LOAD = 64
#: Halvings at most: beyond it a cell is 2 ** -36 of the limit wide, and is left as it is.
DEEPEST = 36
SLACK = 1 + 1e-12


def _cells(axes: list[str], size: float) -> dict[str, Column]:
    """The cell of a position: size is a power of two, so that a cell's halves are exactly those of the next level."""
    return {f"_c{i}": F.floor(F.col(a) / size).cast("long") for i, a in enumerate(axes)}


def cell_tree(places: DataFrame, axes: list[str], size: float, load: int = LOAD) -> tuple[list[DataFrame], DataFrame]:
    """(for each level its cells: _c0.., divided), and the places with _level and the cell that holds them.

    places: a written table of different positions. A level deals with the places in crowded cells of the one above only.
    """
    names = [f"_c{i}" for i in range(len(axes))]
    levels, leaves, todo = [], [], places
    while True:
        level = len(levels)
        at = todo.withColumns(_cells(axes, size / 2 ** level))
        crowded = (F.col("n") > load) if level < DEEPEST else F.lit(False)
        cells = settled(at.groupBy(*names).agg(F.count("*").alias("n")).select(*names, crowded.alias("divided")), "cells")
        levels.append(cells)
        at = at.withColumn("_level", F.lit(level))
        if cells.where("divided").limit(1).count() == 0:
            return levels, reduce(DataFrame.unionByName, [*leaves, at])
        divided = cells.where("divided").select(*names)
        leaves.append(at.join(divided, names, "left_anti"))
        todo = settled(at.join(divided, names, "left_semi").select(*places.columns), "places-below")


def _bounds(axes: list[str], size: float) -> tuple[Column, Column]:
    """(least, greatest) squared distance between a position and the points of its row's cell."""
    near, far = F.lit(0.0), F.lit(0.0)
    for i, a in enumerate(axes):
        low = F.col(f"_c{i}") * F.lit(size)
        below, above = low - F.col(a), F.col(a) - (low + size)
        gap, reach = F.greatest(below, above, F.lit(0.0)), F.greatest(F.abs(below), F.abs(above))
        near, far = near + gap * gap, far + reach * reach
    return near, far


def _reached(asks: DataFrame, cells: DataFrame, axes: list[str], size: float, most: float) -> DataFrame:
    near, far = _bounds(axes, size)
    names = [f"_c{i}" for i in range(len(axes))]
    return asks.join(cells, names).withColumns({"near": near, "far": far}).where(F.col("near") <= most * SLACK)


def nearest_rows(queries: DataFrame, rows: DataFrame, row_id: str, axes: list[str], limit: float, load: int = LOAD) -> DataFrame:
    """axes, row_id, d2: for each different position in queries the nearest of the rows within limit; the smaller row_id wins a tie.

    Both sides have axes; positions with a null are left out.
    """
    present = reduce(Column.__and__, [F.col(a).isNotNull() & ~F.isnan(a) for a in axes])
    places = settled(rows.select(row_id, *[F.col(a).cast("double").alias(a) for a in axes]).where(present).groupBy(*axes).agg(F.min(row_id).alias(row_id)), "places")
    size = 2.0 ** math.ceil(math.log2(limit))
    levels, leaves = cell_tree(places, axes, size, load)
    leaves = settled(leaves, "leaves")
    asked = queries.select(*[F.col(a).cast("double").alias(a) for a in axes]).where(present).distinct().withColumn("_q", F.monotonically_increasing_id())
    asked = settled(asked, "queries")
    own, names = _cells(axes, size), [f"_c{i}" for i in range(len(axes))]
    around = F.array(*[F.struct(*[(own[c] + o).alias(c) for c, o in zip(names, off, strict=True)]) for off in product((-1, 0, 1), repeat=len(axes))])
    asks = asked.withColumn("_c", F.explode(around)).select("_q", *axes, "_c.*")
    best = F.min("far").over(Window.partitionBy("_q"))  # a few cells a query
    known, most = None, limit * limit
    for level, cells in enumerate(levels):
        met = _reached(asks, cells, axes, size / 2 ** level, most).withColumn("_level", F.lit(level))
        met = met if known is None else met.unionByName(known)
        front = settled(met.withColumn("best", best).where(F.col("near") <= F.col("best") * SLACK).drop("best"), "search-front")
        known = front.where("not divided")
        halves = F.array(*[F.struct(*[(F.col(c) * 2 + o).alias(c) for c, o in zip(names, off, strict=True)]) for off in product((0, 1), repeat=len(axes))])
        asks = front.where("divided").withColumn("_c", F.explode(halves)).select("_q", *axes, "_c.*")
    held = leaves.select("_level", *names, row_id, *[F.col(a).alias(f"_at{i}") for i, a in enumerate(axes)])
    d2 = reduce(Column.__add__, [(F.col(a) - F.col(f"_at{i}")) * (F.col(a) - F.col(f"_at{i}")) for i, a in enumerate(axes)])
    # first the least distance, a number, so that this is a hash aggregate; then the rows at that distance, which are few. The least of pairs
    # (distance, row) would sort all that a query's leaves hold
    met = lambda k: k.join(held, ["_level", *names]).withColumn("d2", d2)
    known = known.select("_q", *axes, "_level", *names)
    least = settled(met(known).where(F.col("d2") <= most).groupBy("_q").agg(F.min("d2").alias("_least")), "least-distances")
    found = met(known.join(least, "_q")).where(F.col("d2") == F.col("_least")).groupBy("_q", *axes, "d2").agg(F.min(row_id).alias(row_id))
    return settled(found.select(*axes, row_id, "d2"), "nearest")


def matched(left: DataFrame, right: DataFrame, left_id: str, right_id: str, axes: list[str], limit: float, used: DataFrame | None = None, accept: Column | None = None, rounds: int | None = 1, load: int = LOAD) -> DataFrame:
    """left_id, right_id, d2, round: each row of left takes the nearest unused row of right within limit, then comes the test ``accept`` on
    that pair (a nearest one that fails isn't replaced by a farther one), then each row of right goes to its nearest taker.

    Rows that were beaten to their candidate try again among those still unused, up to ``rounds`` times (None: until none is beaten).
    Both sides have axes and the columns that accept names; those of right are prefixed with r_. Ids are unique; the smaller one wins ties.
    """
    rest, todo = [c for c in right.columns if c != right_id], left
    free = right if used is None else right.join(used.select(right_id).distinct(), right_id, "left_anti")
    out, n = [], 0
    while True:
        n += 1
        near = nearest_rows(todo, free, right_id, axes, limit, load)
        takes = todo.join(near, axes)
        if accept is not None:
            takes = takes.join(free.select(right_id, *[F.col(c).alias(f"r_{c}") for c in rest]), right_id).where(accept)
        takes = settled(takes.select(left_id, right_id, "d2"), "takes")
        given = settled(takes.groupBy(right_id).agg(F.min(F.struct("d2", left_id)).alias("m")).select(f"m.{left_id}", right_id, "m.d2", F.lit(n).alias("round")), "given")
        out.append(given)
        if rounds is None or n < rounds:
            beaten = settled(takes.select(left_id).join(given.select(left_id), left_id, "left_anti"), "beaten")
            if beaten.limit(1).count():
                todo = settled(left.join(beaten, left_id, "left_semi"), "left-again")
                free = settled(free.join(given.select(right_id), right_id, "left_anti"), "still-unused")
                continue
        return reduce(DataFrame.unionByName, out)


def sky_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, arcsec: float, lon: str = "ra", lat: str = "dec", **options) -> DataFrame:
    """left_id, right_id, sep (arc seconds), round: ``matched`` on the sphere, by the chords between unit vectors, so that neither the
    poles nor the change from 360 to 0 degrees is special. lon and lat are degrees."""
    axes = ["_ux", "_uy", "_uz"]
    placed = [d.withColumns(dict(zip(axes, unit_vector(F.col(lon), F.col(lat)), strict=True))) for d in (left, right)]
    found = matched(*placed, left_id, right_id, axes, 2 * math.sin(math.radians(arcsec / 3600) / 2), **options)
    return found.select(left_id, right_id, (F.degrees(2 * F.asin(F.sqrt("d2") / 2)) * 3600).alias("sep"), "round")
