"""Longitude and latitude to metres on the unified Korean grid: transverse Mercator by the Krueger series on GRS80."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 and the grid's origin, scale and offsets.
AXIS, FLATTENING = 6_378_137.0, 1 / 298.257222101
ORIGIN_LON, ORIGIN_LAT, SCALE, EAST, NORTH = 127.5, 38.0, 0.9996, 1_000_000.0, 2_000_000.0

N = FLATTENING / (2 - FLATTENING)
RADIUS = AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
SERIES = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)
SQUEEZE = 2 * math.sqrt(N) / (1 + N)


def _meridian(lat: float) -> float:
    """Series northing of a latitude on the central meridian."""
    s = math.sin(math.radians(lat))
    xi = math.atan(math.sinh(math.atanh(s) - SQUEEZE * math.atanh(SQUEEZE * s)))
    return xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(SERIES, 1))


START = _meridian(ORIGIN_LAT)


def to_metres(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in metres."""
    s, turn = F.sin(F.radians(lat)), F.radians(lon - ORIGIN_LON)
    t = F.sinh(F.atanh(s) - SQUEEZE * F.atanh(SQUEEZE * s))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    x, y = eta, xi - START
    for j, a in enumerate(SERIES, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST + SCALE * RADIUS * x, NORTH + SCALE * RADIUS * y
