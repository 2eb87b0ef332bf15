"""Distances in a flat universe with matter and a constant: on the driver a table, per row an interpolation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column

from prismview.functions.scalars import interpolated

C_KMS = 299792.458
RADIAN_ARCSEC = 206264.80624709636


def expansion(z: np.ndarray, matter: float = 0.3) -> np.ndarray:
    return np.sqrt(matter * (1 + z) ** 3 + 1 - matter)


def comoving_distance(z: float, h0: float = 70.0, matter: float = 0.3, steps: int = 256) -> float:
    """Mpc, by Simpson's rule."""
    x = np.linspace(0.0, z, 2 * steps + 1)
    f = 1 / expansion(x, matter)
    return float(C_KMS / h0 * (x[1] - x[0]) / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-2:2].sum())) if z > 0 else 0.0


def angular_diameter_distance(z: float, **c) -> float:
    return comoving_distance(z, **c) / (1 + z)


def luminosity_distance(z: float, **c) -> float:
    return comoving_distance(z, **c) * (1 + z)


def kpc_per_arcsec(z: float, **c) -> float:
    return angular_diameter_distance(z, **c) * 1000 / RADIAN_ARCSEC


def kpc_per_arcsec_column(z: Column, top: float = 0.3, points: int = 121, **c) -> Column:
    return interpolated([(float(v), kpc_per_arcsec(float(v), **c)) for v in np.linspace(0, top, points)], z)
