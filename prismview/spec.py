"""What a view is: dimensions, categories, filters and a frame, as plain immutable data.

A view is a two-dimensional linear projection of standardized dimensions, with filters and a colour variable. Its
parameters are literals in the plan; a changed view is a new plan over the same columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from urllib.parse import parse_qs, urlencode


@dataclass(frozen=True)
class DimSpec:
    key: str
    label: str
    low: float
    high: float
    center: float = 0.0
    scale: float = 1.0
    group: str = ""
    unit: str = ""

    def standardized(self, x: float) -> float:
        return (x - self.center) / self.scale


@dataclass(frozen=True)
class CatSpec:
    key: str
    label: str
    codes: tuple[tuple[int, str], ...]

    @staticmethod
    def normalized(spec: dict, index: int) -> CatSpec:
        """Accepts codes as a list of {code, label} or a map code -> label; keeps codes 1..7 in order."""
        given = spec.get("codes") or []
        pairs = given.items() if isinstance(given, dict) else [(c.get("code", i + 1), c.get("label", c.get("name", ""))) if isinstance(c, dict) else (i + 1, c) for i, c in enumerate(given)]
        pairs = [(int(k), v.get("label", "") if isinstance(v, dict) else str(v)) for k, v in pairs]
        return CatSpec(spec.get("key", f"cat{index}"), spec.get("label", spec.get("key", "")), tuple(sorted((k, v) for k, v in pairs if 1 <= k <= 7)))


@dataclass(frozen=True)
class ViewSpec:
    """x and y: weights of standardized dimensions. ranges: closed intervals of physical values; masks: allowed codes per
    category; need: dimensions that must be present."""

    x: tuple[tuple[str, float], ...]
    y: tuple[tuple[str, float], ...]
    color: str | None = None
    ranges: tuple[tuple[str, float, float], ...] = ()
    masks: tuple[tuple[str, tuple[int, ...]], ...] = ()
    need: tuple[str, ...] = ()
    window: tuple[float, float, float, float] = field(default=(-3.0, 3.0, -3.0, 3.0))

    def with_axis(self, axis: str, key: str) -> ViewSpec:
        """key alone on one axis and the other axis kept; if that one already is (nearly) this dimension, it takes what was on the first."""
        if axis not in ("x", "y"):
            raise ValueError(f"no axis {axis}")
        rest = "y" if axis == "x" else "x"
        weight = dict(getattr(self, rest))
        norm = math.sqrt(sum(v * v for v in weight.values())) or 1.0
        kept = getattr(self, axis) if abs(weight.get(key, 0.0)) / norm > 0.9 else getattr(self, rest)
        return replace(self, **{axis: ((key, 1.0),), rest: kept})

    def with_filter(self, key: str, low: float, high: float) -> ViewSpec:
        return replace(self, ranges=tuple(r for r in self.ranges if r[0] != key) + ((key, low, high),))

    def with_mask(self, key: str, codes: tuple[int, ...] | None) -> ViewSpec:
        rest = tuple(m for m in self.masks if m[0] != key)
        return replace(self, masks=rest if codes is None else (*rest, (key, tuple(sorted(codes)))))

    def toggled(self, key: str, code: int, every: tuple[int, ...], solo: bool = False) -> ViewSpec:
        """A class switched on or off (none left: all); solo leaves it alone, solo again brings back all."""
        now = set(dict(self.masks).get(key, every))
        new = (set(every) if now == {code} else {code}) if solo else now ^ {code}
        return self.with_mask(key, None if not new or new == set(every) else tuple(new))

    def to_query_string(self) -> str:
        combo = lambda c: ",".join(f"{k}:{w!r}" for k, w in c)
        parts = {"x": combo(self.x), "y": combo(self.y)}
        if self.color:
            parts["c"] = self.color
        if self.ranges:
            parts["r"] = ";".join(f"{k}:{a!r}:{b!r}" for k, a, b in self.ranges)
        if self.masks:
            parts["m"] = ";".join(f"{k}:{'.'.join(map(str, c))}" for k, c in self.masks)
        if self.need:
            parts["n"] = ",".join(self.need)
        return urlencode(parts)

    @staticmethod
    def from_query_string(text: str) -> ViewSpec:
        p = {k: v[0] for k, v in parse_qs(text).items()}
        combo = lambda s: tuple((k, float(w)) for k, w in (t.rsplit(":", 1) for t in s.split(",") if t))
        ranges = tuple((k, float(a), float(b)) for k, a, b in (t.split(":") for t in p.get("r", "").split(";") if t))
        masks = tuple((k, tuple(int(c) for c in v.split(".") if c)) for k, v in (t.split(":") for t in p.get("m", "").split(";") if t))
        return ViewSpec(combo(p.get("x", "")), combo(p.get("y", "")), p.get("c"), ranges, masks, tuple(t for t in p.get("n", "").split(",") if t))
