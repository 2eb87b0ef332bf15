"""Which points lie in which of many polygons: polygons are cut into the pieces of a grid, and points meet the pieces of their cell only.

The even-odd rule is exact: a point on a given height is crossed only by edges that reach its band, and these are all in the piece. So the
result equals ``functions.scalars.inside_polygon`` of every polygon in turn, without a test of every pair.

``in_polygons`` gives the pairs; ``counted_in_polygons`` gives their number for each polygon without forming them: equal points and equal
polygons are worked out once, and cells that no side touches are counted as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismview.functions.shared import settled

#: Bands and columns of the grid over all polygons.
BANDS = 64
#: Edges in pieces that are sent to every task at most (32 bytes each); more are joined by a shuffle.
SENT = 1 << 18
#: Points of a cell that one task takes in that shuffle; a cell with more is split.
LOAD = 1 << 16
#: Different points of a cell, on average, where they are counted, and bands of that grid at most.
CELL, FINEST = 16, 2048


def edges(polygons: DataFrame, level: bool = False) -> DataFrame:
    """polygon, xa, ya, xb, yb: the sides of polygons given as vertices (polygon, i, x, y), closed; level sides are left out unless asked for.

    Vertices go by i, then x and y; one without two finite coordinates is left out. A null polygon is a polygon like any other.
    """
    whole = F.abs(F.col("x")) + F.abs(F.col("y")) < F.lit(float("inf"))
    v = polygons.select("polygon", "i", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(whole)
    order = Window.partitionBy("polygon").orderBy("i", "x", "y")  # a polygon's own vertices
    first = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    follows = F.lead(F.struct("x", "y")).over(order)
    b = F.coalesce(follows, F.first(F.struct("x", "y")).over(first))
    e = v.select("polygon", F.col("x").alias("xa"), F.col("y").alias("ya"), b.alias("b")).select("polygon", "xa", "ya", F.col("b.x").alias("xb"), F.col("b.y").alias("yb"))
    return e if level else e.where("ya <> yb")


class Grid:
    """Cells over the polygons' bounding box. A cell number never falls as a coordinate grows, so an edge reaches every band of its points."""

    def __init__(self, sides: DataFrame, bands: int):
        low = lambda a, b: F.min(F.least(a, b))
        high = lambda a, b: F.max(F.greatest(a, b))
        self.x0, self.x1, self.y0, self.y1 = sides.agg(low("xa", "xb"), high("xa", "xb"), low("ya", "yb"), high("ya", "yb")).first()
        self.empty = self.x0 is None
        self.cut(bands)

    def cut(self, bands: int) -> Grid:
        self.bands = bands
        if not self.empty:
            self.wide, self.tall = ((b - a) / bands or 1.0 for a, b in ((self.x0, self.x1), (self.y0, self.y1)))
        return self

    def _cell(self, v: Column, start: float, size: float) -> Column:
        return F.least(F.greatest(F.floor((v - F.lit(start)) / F.lit(size)), F.lit(0)), F.lit(self.bands - 1)).cast("int")

    def band(self, y: Column) -> Column:
        return self._cell(y, self.y0, self.tall)

    def column(self, x: Column) -> Column:
        return self._cell(x, self.x0, self.wide)


def pieces(sides: DataFrame, grid: Grid) -> DataFrame:
    """polygon, band, column, sides: of each cell that a polygon may cover, the polygon's sides that reach its band."""
    low, high = F.least("ya", "yb"), F.greatest("ya", "yb")
    cut = sides.withColumn("band", F.explode(F.sequence(grid.band(low), grid.band(high))))
    # where the side enters and leaves the band, with some room for rounding
    at = lambda y: F.col("xa") + (F.col("xb") - F.col("xa")) * ((F.least(F.greatest(y, low), high) - F.col("ya")) / (F.col("yb") - F.col("ya")))
    enters, leaves = at(F.lit(grid.y0) + F.col("band") * grid.tall), at(F.lit(grid.y0) + (F.col("band") + 1) * grid.tall)
    room = grid.wide * 1e-6
    held = cut.groupBy("polygon", "band").agg(F.min(F.least(enters, leaves) - room).alias("l"), F.max(F.greatest(enters, leaves) + room).alias("r"), F.collect_list(F.struct("xa", "ya", "xb", "yb")).alias("sides"))
    return held.select("polygon", "band", F.explode(F.sequence(grid.column(F.col("l")), grid.column(F.col("r")))).alias("column"), "sides")


def _odd(x: Column, y: Column, sides: Column) -> Column:
    crosses = lambda s: ((s["ya"] > y) != (s["yb"] > y)) & (x < (s["xb"] - s["xa"]) * (y - s["ya"]) / (s["yb"] - s["ya"]) + s["xa"])
    return F.size(F.filter(sides, crosses)) % 2 == 1


def _met(p: DataFrame, cut: DataFrame, row: str, load: int) -> DataFrame:
    """Points with the pieces of their cell, by a shuffle in which a cell with over ``load`` points is split."""
    loads = settled(p.groupBy("_band", "_column").agg(F.count("*").alias("n")).where(F.col("n") > load).select(F.col("_band").alias("_b"), F.col("_column").alias("_c"), F.ceil(F.col("n") / load).cast("int").alias("parts")), "loads")
    hot = F.broadcast(loads)  # a row for each cell of the grid at most
    salt = lambda d, of: d.withColumn("_salt", of(F.coalesce("parts", F.lit(1)))).drop("_b", "_c", "parts")
    p = salt(p.join(hot, (F.col("_band") == F.col("_b")) & (F.col("_column") == F.col("_c")), "left"), lambda n: F.pmod(F.xxhash64(row), n).cast("int"))
    cut = salt(cut.join(hot, (F.col("band") == F.col("_b")) & (F.col("column") == F.col("_c")), "left"), lambda n: F.explode(F.sequence(F.lit(0), n - 1))).withColumnRenamed("_salt", "salt")
    return p.join(cut.hint("shuffle_hash"), (F.col("_band") == F.col("band")) & (F.col("_column") == F.col("column")) & (F.col("_salt") == F.col("salt")))


def in_polygons(points: DataFrame, x: Column, y: Column, polygons: DataFrame, bands: int = BANDS, sent: int = SENT, load: int = LOAD) -> DataFrame:
    """The rows of points with ``polygon``, once for each polygon that they lie in (even-odd rule).

    The pieces are counted: up to ``sent`` edges go to every task; more are joined by a shuffle, in which a cell with over ``load`` points
    is split by a salt and its pieces repeated. Points without finite coordinates, and polygons of fewer than three vertices, match
    nothing. points mustn't have a column named polygon.
    """
    sides = settled(edges(polygons), "sides")
    grid = Grid(sides, bands)
    if grid.empty:
        return points.join(sides.select("polygon"), F.lit(False))
    cut = settled(pieces(sides, grid), "pieces")
    p = points.select(F.struct("*").alias("_row"), x.cast("double").alias("_x"), y.cast("double").alias("_y"))
    p = p.where(F.col("_x").between(grid.x0, grid.x1) & F.col("_y").between(grid.y0, grid.y1))  # false for NaN
    p = p.withColumn("_band", grid.band(F.col("_y"))).withColumn("_column", grid.column(F.col("_x")))
    here = (F.col("_band") == F.col("band")) & (F.col("_column") == F.col("column"))
    few = (cut.agg(F.sum(F.size("sides"))).first()[0] or 0) <= sent
    met = p.join(F.broadcast(cut), here) if few else _met(p, cut, "_row", load)
    return met.where(_odd(F.col("_x"), F.col("_y"), F.col("sides"))).select("_row.*", "polygon")


def _shapes(polygons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shape, i, x, y of the different polygons), (polygon, shape): polygons with the same vertices in the same order are one shape."""
    v = polygons.select("polygon", "i", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(F.abs(F.col("x")) + F.abs(F.col("y")) < F.lit(float("inf")))
    each = v.groupBy("polygon").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("_v"))  # a polygon's own vertices
    each = settled(each.select("polygon", F.transform("_v", lambda p: F.struct(p["x"], p["y"])).alias("_v")), "polygons")
    shapes = settled(each.select("_v").distinct().withColumn("shape", F.monotonically_increasing_id()), "shapes")
    return shapes.select(F.col("shape").alias("polygon"), F.posexplode("_v").alias("i", "p")).select("polygon", "i", "p.x", "p.y"), each.join(shapes.hint("shuffle_hash"), "_v").select("polygon", "shape")


def _bands(sides: DataFrame, grid: Grid) -> DataFrame:
    """polygon, band, sides, touched: of each band that a polygon reaches its sides there (without level ones), and the columns that any of them may touch, in order."""
    low, high, room = F.least("ya", "yb"), F.greatest("ya", "yb"), 1e-6
    cut = sides.withColumn("band", F.explode(F.sequence(grid.band(low), grid.band(high))))
    level = F.col("ya") == F.col("yb")
    at = lambda k: F.col("xa") + (F.col("xb") - F.col("xa")) * ((F.least(F.greatest(F.lit(grid.y0) + k * F.lit(grid.tall), low), high) - F.col("ya")) / F.nullif(F.col("yb") - F.col("ya"), F.lit(0.0)))
    a, b = (F.when(level, F.col(x)).otherwise(at(F.col("band") + k)) for x, k in (("xa", -room), ("xb", 1 + room)))
    reach = F.sequence(grid.column(F.least(a, b) - room * grid.wide), grid.column(F.greatest(a, b) + room * grid.wide))
    held = cut.select("polygon", "band", reach.alias("reach"), F.when(~level, F.struct("xa", "ya", "xb", "yb")).alias("side"))
    return held.groupBy("polygon", "band").agg(F.collect_list("side").alias("sides"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reach")))).alias("touched"))


def counted_in_polygons(points: DataFrame, x: Column, y: Column, polygons: DataFrame, sums: dict[str, Column] | None = None, bands: int | None = None, load: int = LOAD) -> DataFrame:
    """polygon, n and sums (of whole numbers) over the points in each polygon that holds any: what ``in_polygons`` gives, grouped by polygon.

    The grid has a cell for every ``CELL`` different points (up to ``FINEST`` bands and columns; bands: a number of your own). Between the cells of a band that
    a side touches, all points are inside or all are outside: those inside are the difference of two running sums along the band. In
    touched cells each different point is tested. Both kinds of rows are as many as a shape's outline has cells.
    """
    sums = sums or {}
    names = ["n", *sums]
    vertices, shape_of = _shapes(polygons)
    sides = settled(edges(vertices, level=True), "sides")
    grid = Grid(sides, 1)
    none = points.select(*[c.cast("long").alias(k) for k, c in sums.items()])
    if grid.empty:
        return none.join(shape_of.select("polygon"), F.lit(False)).select("polygon", F.lit(0).cast("long").alias("n"), *sums)
    p = points.select(x.cast("double").alias("_x"), y.cast("double").alias("_y"), *[c.cast("long").alias(k) for k, c in sums.items()])
    p = p.where(F.col("_x").between(grid.x0, grid.x1) & F.col("_y").between(grid.y0, grid.y1))  # false for NaN
    p = settled(p.groupBy("_x", "_y").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in sums]), "places")
    grid = grid.cut(bands or min(FINEST, max(1, math.isqrt(p.count() // CELL))))
    p = p.withColumns({"_band": grid.band(F.col("_y")), "_column": grid.column(F.col("_x"))})
    cut = settled(_bands(sides, grid), "pieces", sides)

    touched = cut.where(F.size("sides") > 0).select("polygon", "band", "sides", F.explode("touched").alias("column"))
    tested = _met(p, touched, "_x", load).where(_odd(F.col("_x"), F.col("_y"), F.col("sides"))).groupBy("polygon").agg(*[F.sum(k).alias(k) for k in names])

    # the gaps between touched columns, tested at the middle of their first cell
    t = F.col("touched")
    gaps = F.filter(F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda g: g["b"] > g["a"] + 1)
    gap = cut.select("polygon", "band", "sides", F.explode(gaps).alias("gap"))
    middle = lambda c, start, size: F.lit(start) + (c + 0.5) * F.lit(size)
    gap = gap.where(_odd(middle(F.col("gap.a") + 1, grid.x0, grid.wide), middle(F.col("band"), grid.y0, grid.tall), F.col("sides")))
    ends = gap.select("polygon", "band", F.explode(F.array(F.struct(F.col("gap.a").alias("column"), F.lit(-1).alias("sign")), F.struct((F.col("gap.b") - 1).alias("column"), F.lit(1).alias("sign")))).alias("e")).select("polygon", "band", "e.*")
    cells = p.groupBy(F.col("_band").alias("band"), F.col("_column").alias("column")).agg(*[F.sum(k).alias(k) for k in names])
    every = points.sparkSession.range(grid.bands ** 2).select(F.floor(F.col("id") / grid.bands).cast("int").alias("band"), (F.col("id") % grid.bands).cast("int").alias("column"))
    along = Window.partitionBy("band").orderBy("column").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # FINEST cells at most, unless asked for more
    running = every.join(cells, ["band", "column"], "left").select("band", "column", *[F.sum(F.coalesce(k, F.lit(0))).over(along).alias(k) for k in names])
    whole = ends.join(running.hint("shuffle_hash"), ["band", "column"]).groupBy("polygon").agg(*[F.sum(F.col("sign") * F.col(k)).alias(k) for k in names])

    found = tested.unionByName(whole).groupBy(F.col("polygon").alias("shape")).agg(*[F.sum(k).alias(k) for k in names]).where("n > 0")
    return shape_of.join(found, "shape").select("polygon", *names)
