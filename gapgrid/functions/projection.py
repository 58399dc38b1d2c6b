"""Transverse Mercator (Krüger series, WGS84) as ``Column`` expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapgrid.params import DEFAULT, Params

# WGS84 and UTM (south) constants.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500000.0, 10000000.0

_N = FLATTENING / (2 - FLATTENING)
RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ECC = 2 * math.sqrt(_N) / (1 + _N)
# Third-order series in the third flattening.
ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def project_xy(lat, lon, p: Params = DEFAULT) -> tuple[Column, Column]:
    """(east, north) metres in the zone of ``p.utm_central_meridian``."""
    s = F.sin(F.radians(_c(lat)))
    dl = F.radians(_c(lon) - p.utm_central_meridian)
    t = F.sinh(F.atanh(s) - ECC * F.atanh(ECC * s))
    xi0, eta0 = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    xi, eta = xi0, eta0
    for j, a in enumerate(ALPHA, start=1):
        xi = xi + a * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta + a * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    return FALSE_EAST + SCALE * RADIUS * eta, FALSE_NORTH + SCALE * RADIUS * xi


def unproject_xy(x, y, p: Params = DEFAULT) -> tuple[Column, Column]:
    """(lat, lon) degrees of a projected point."""
    xi0, eta0 = (_c(y) - FALSE_NORTH) / (SCALE * RADIUS), (_c(x) - FALSE_EAST) / (SCALE * RADIUS)
    xi, eta = xi0, eta0
    for j, b in enumerate(BETA, start=1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(DELTA, start=1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(lat), F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + p.utm_central_meridian
