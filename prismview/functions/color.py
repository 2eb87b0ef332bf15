"""Colours: hex text, and ramps that are even in the OKLab space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The published OKLab matrices (linear sRGB to cone responses, these to Lab) and their inverses.
TO_CONES = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
FROM_LAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
FROM_CONES = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))


def rgb(hexes: str) -> tuple[float, float, float]:
    v = int(hexes.lstrip("#"), 16)
    return (v >> 16) / 255, (v >> 8 & 255) / 255, (v & 255) / 255


def lab(hexes: str) -> tuple[float, ...]:
    """OKLab of a hex colour."""
    linear = [c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in rgb(hexes)]
    cones = [sum(m * c for m, c in zip(row, linear, strict=True)) ** (1 / 3) for row in TO_CONES]
    return tuple(sum(m * c for m, c in zip(row, cones, strict=True)) for row in TO_LAB)


def hex_of(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of three numbers in 0..1."""
    two = lambda c: F.lpad(F.lower(F.hex(F.floor(255 * c + 0.5).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def ramp(t: Column, stops: tuple[str, ...]) -> Column:
    """Hex colour at t (0..1, clamped) along stops; reverse the stops for the other direction. A few stops, held in the plan."""
    labs = [lab(x) for x in stops]
    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)) * (len(stops) - 1)
    k = F.least(F.floor(u), F.lit(len(stops) - 2)).cast("int")
    on = lambda i: F.get(F.array(*[F.lit(x[i]) for x in labs]), k)
    nx = lambda i: F.get(F.array(*[F.lit(x[i]) for x in labs]), k + 1)
    mixed = [on(i) + (nx(i) - on(i)) * (u - k) for i in range(3)]
    cones = [F.pow(m[0] * mixed[0] + m[1] * mixed[1] + m[2] * mixed[2], F.lit(3.0)) for m in (tuple(F.lit(v) for v in row) for row in FROM_LAB)]
    linear = [F.lit(m[0]) * cones[0] + F.lit(m[1]) * cones[1] + F.lit(m[2]) * cones[2] for m in FROM_CONES]
    inside = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)) for c in linear]
    return hex_of(*[F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055) for c in inside])


def ramp_sql(source: str, key: str, stops: tuple[str, ...]) -> str:
    """The same in SQL, for a query with the columns key and t."""
    labs = [lab(x) for x in stops]
    cols = ", ".join(f"{[x[i] for x in labs]} AS p{i}" for i in range(3))
    mix = ", ".join(f"p{i}[k + 1] + (p{i}[k + 2] - p{i}[k + 1]) * (u - k) AS m{i}" for i in range(3))
    cones = ", ".join(f"pow({r[0]!r} * m0 + {r[1]!r} * m1 + {r[2]!r} * m2, 3) AS c{i}" for i, r in enumerate(FROM_LAB))
    linear = ", ".join(f"least(1.0, greatest(0.0, {r[0]!r} * c0 + {r[1]!r} * c1 + {r[2]!r} * c2)) AS l{i}" for i, r in enumerate(FROM_CONES))
    two = " || ".join(f"format('{{:02x}}', floor(255 * (CASE WHEN l{i} <= 0.0031308 THEN 12.92 * l{i} ELSE 1.055 * pow(l{i}, {1 / 2.4!r}) - 0.055 END) + 0.5)::BIGINT)" for i in range(3))
    return f"""WITH a AS (SELECT {key}, least(1.0, greatest(0.0, t)) * {len(stops) - 1} AS u FROM ({source})), b AS (SELECT {key}, u, least(floor(u), {len(stops) - 2})::INTEGER AS k, {cols} FROM a),
m AS (SELECT {key}, {mix} FROM b), c AS (SELECT {key}, {cones} FROM m), l AS (SELECT {key}, {linear} FROM c) SELECT {key}, '#' || {two} AS color FROM l"""
