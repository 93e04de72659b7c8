"""Compass maths as column expressions, in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayline.functions.geo import shortest_turn


def normalise(a: Column) -> Column:
    return F.pmod(a, F.lit(360))


def ease_bearing(start: Column, end: Column, weight: Column) -> Column:
    return normalise(start + shortest_turn(start, end) * weight)


def facing(alpha: Column, beta: Column, gamma: Column, screen: Column) -> Column:
    """Where the upper edge or the back of a device points, whichever is flatter; null if both point up or down."""
    ca, sa, cb, sb, cg, sg, cs, ss = (f(F.radians(x)) for x in (alpha, beta, gamma, screen) for f in (F.cos, F.sin))
    east = (ca * cg - sa * sb * sg, -sa * cb, ca * sg + sa * sb * cg)
    north = (sa * cg + ca * sb * sg, ca * cb, sa * sg - ca * sb * cg)
    top_e, top_n = east[0] * ss + east[1] * cs, north[0] * ss + north[1] * cs
    top, back = F.hypot(top_e, top_n), F.hypot(east[2], north[2])
    e, n = top_e * top - east[2] * back, top_n * top - north[2] * back
    return F.when(F.round(F.hypot(e, n), 6) >= 0.2, normalise(F.round(F.degrees(F.atan2(e, n)), 3)))


def read_heading(compass: Column, accuracy: Column, absolute: Column, alpha: Column, screen: Column) -> Column:
    """A compass heading with known accuracy, else the turn of an absolute flat pose."""
    own = F.when(accuracy >= 0, normalise(compass + screen))
    return F.when(compass.isNotNull(), own).when(absolute, normalise(720 - alpha + screen))
