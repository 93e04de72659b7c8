"""Spherical and planar geometry as column expressions. Angles are degrees, lengths metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6371000.0
METRES_PER_DEGREE = 111320.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(h))


def flat_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance at the mean latitude."""
    east = (lon2 - lon1) * METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(east, (lat2 - lat1) * METRES_PER_DEGREE)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, -180 to 180."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))


def angle_between(a: Column, b: Column) -> Column:
    """0 to 180."""
    d = F.abs(F.pmod(a - b, F.lit(360.0)))  # not minus zero
    return F.least(d, 360 - d)


def shortest_turn(start: Column, end: Column) -> Column:
    """Over -180, up to 180."""
    d = F.pmod(end - start, F.lit(360.0))
    return F.when(d > 180, d - 360).otherwise(d)


def nearest_whole(x: Column) -> Column:
    """Half goes up, also below zero."""
    return F.floor(x + 0.5)


def lon_scale(mid_lat: Column) -> Column:
    return METRES_PER_DEGREE * F.cos(F.radians(mid_lat))


def share_of_segment(lat: Column, lon: Column, seg: dict[str, Column]) -> Column:
    """Where a point's foot lies on a segment, 0 to 1, in the plane at its start."""
    bx, by = (seg["b_lon"] - seg["a_lon"]) * seg["scale"], (seg["b_lat"] - seg["a_lat"]) * METRES_PER_DEGREE
    px, py = (lon - seg["a_lon"]) * seg["scale"], (lat - seg["a_lat"]) * METRES_PER_DEGREE
    square = bx * bx + by * by
    return F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * bx + py * by) / square)))


def offset_from_segment(lat: Column, lon: Column, seg: dict[str, Column], t: Column) -> Column:
    bx, by = (seg["b_lon"] - seg["a_lon"]) * seg["scale"], (seg["b_lat"] - seg["a_lat"]) * METRES_PER_DEGREE
    px, py = (lon - seg["a_lon"]) * seg["scale"], (lat - seg["a_lat"]) * METRES_PER_DEGREE
    return F.hypot(px - bx * t, py - by * t)


def tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the map tile."""
    n = float(1 << zoom)
    x = F.floor((lon + 180) / 360 * n)
    r = F.radians(lat)
    y = F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / F.lit(3.141592653589793)) / 2 * n)
    return x, y
