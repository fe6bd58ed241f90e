"""Geometry and geodesy as column functions: doubles in, doubles out.

Four metric spaces are kept apart on purpose: flat metres about latitude 40.7,
a local equirectangular distance, the run-bearing scale, and the sphere.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

#: Metres a degree of longitude on the equator and of latitude, and the sphere's radius.
LON_M, LAT_M, RADIUS_M = 111320.0, 110540.0, 6371000.0
FLAT_LAT = 40.7


def flat_x(lon: Column) -> Column:
    return lon * F.lit(LON_M * math.cos(math.radians(FLAT_LAT)))


def flat_y(lat: Column) -> Column:
    return lat * F.lit(LAT_M)


def segment_t(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where along a segment a point's projection falls, 0..1; 0 for a segment without length."""
    dx, dy = bx - ax, by - ay
    t = ((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = segment_t(px, py, ax, ay, bx, by)
    ex, ey = px - ax - t * (bx - ax), py - ay - t * (by - ay)
    return F.sqrt(ex * ex + ey * ey)


def undirected(bearing: Column) -> Column:
    return F.pmod(bearing, F.lit(180.0))


def turn_between(a: Column, b: Column, period: float = 360.0) -> Column:
    """The smaller angle between two bearings."""
    d = F.pmod(F.abs(a - b), F.lit(period))
    return F.least(d, F.lit(period) - d)


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Forward bearing in degrees from north, with the cosine of the mean latitude."""
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.pmod(F.degrees(F.atan2(dx, lat2 - lat1)), F.lit(360.0))


def local_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Equirectangular metres with one scale on both axes."""
    dx = (lon2 - lon1) * LON_M * F.cos(F.radians((lat1 + lat2) / 2))
    dy = (lat2 - lat1) * LON_M
    return F.sqrt(dx * dx + dy * dy)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_M * F.asin(F.sqrt(a))


def _vincenty(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray, rounds: int) -> np.ndarray:
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2, span = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2))), np.radians(lon2 - lon1)
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)

    def over(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.divide(x, y, out=np.zeros_like(x), where=y != 0)

    turn = span
    for left in range(rounds, -1, -1):
        x, y = c2 * np.sin(turn), c1 * s2 - s1 * c2 * np.cos(turn)
        sin, cos = np.sqrt(x * x + y * y), s1 * s2 + c1 * c2 * np.cos(turn)
        sa = over(c1 * c2 * np.sin(turn), sin)
        sigma, cos2 = np.arctan2(sin, cos), 1 - sa * sa
        mid = np.where(cos2 != 0, cos - over(2 * s1 * s2, cos2), 0.0)
        if left:
            c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
            turn = span + (1 - c) * f * sa * (sigma + c * sin * (mid + c * cos * (2 * mid * mid - 1)))
    uu = cos2 * (a * a - b * b) / (b * b)
    big = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
    small = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
    last = small / 6 * mid * (4 * sin * sin - 3) * (4 * mid * mid - 3)
    delta = small * sin * (mid + small / 4 * (cos * (2 * mid * mid - 1) - last))
    return b * big * (sigma - delta)


def vincenty(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 8) -> Column:
    """Metres on the WGS84 ellipsoid by the inverse formula, with a fixed number of rounds; 0 for equal points.

    The rounds run on arrays of a batch: Spark interprets an ``aggregate``, which cost more than all else of a graph.
    """
    def metres(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
        return pd.Series(_vincenty(*(c.to_numpy(dtype=float) for c in (lon1, lat1, lon2, lat2)), rounds))

    return F.pandas_udf(metres, "double")(*(c.cast("double") for c in (lon1, lat1, lon2, lat2)))


def side_of_line(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """1 on the left of a directed line or on it, -1 on its right."""
    return F.when((bx - ax) * (py - ay) - (by - ay) * (px - ax) >= 0, 1).otherwise(-1)


def cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size)).cast("long")


def feet_position(lon: Column, lat: Column) -> tuple[Column, Column]:
    """US survey feet on the two-parallel Lambert cone of the region's state plane (GRS80)."""
    a, f, foot = 6378137.0, 1 / 298.257222101, 0.3048006096012192
    e = math.sqrt(2 * f - f * f)
    first, second, origin, meridian = map(math.radians, (40 + 40 / 60, 41 + 2 / 60, 40 + 10 / 60, -74.0))

    def m(p: float) -> float:
        return math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)

    def t(p: float) -> float:
        return math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)

    n = (math.log(m(first)) - math.log(m(second))) / (math.log(t(first)) - math.log(t(second)))
    big = m(first) / (n * t(first) ** n)
    r0 = a * big * t(origin) ** n
    p = F.radians(lat)
    tt = F.tan(math.pi / 4 - p / 2) / F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), F.lit(e / 2))
    r, theta = a * big * F.pow(tt, F.lit(n)), n * (F.radians(lon) - meridian)
    return (300000.0 + r * F.sin(theta)) / foot, (r0 - r * F.cos(theta)) / foot
