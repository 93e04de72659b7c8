"""Areas as bags of edges: boxes, label points, and which areas hold a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Degrees of the smallest grid cell, how many times wider each next level's are, the number of levels, and degrees of a band of latitude
#: that an area's edges are dealt to.
CELL, WIDER, LEVELS, BAND = 0.02, 4, 8, 0.002


def shapes(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``area_id``, south, north, west, east, and the label point ``lat``, ``lon``: the area's label, else its admin_centre, else its box's middle.

    edges: area_id, a_lat, a_lon, b_lat, b_lon, in any order and direction; labels: area_id, role (label or admin_centre), l_lat, l_lon.
    """
    boxes = edges.groupBy("area_id").agg(
        F.min(F.least("a_lat", "b_lat")).alias("south"), F.max(F.greatest("a_lat", "b_lat")).alias("north"),
        F.min(F.least("a_lon", "b_lon")).alias("west"), F.max(F.greatest("a_lon", "b_lon")).alias("east"),
    )
    middle = boxes.withColumns({"lat": (F.col("south") + F.col("north")) / 2, "lon": (F.col("west") + F.col("east")) / 2})
    if labels is None:
        return middle
    rank = F.when(F.col("role") == "label", 0).otherwise(1)
    best = labels.where(F.col("role").isin("label", "admin_centre")).groupBy("area_id").agg(F.min(F.struct(rank.alias("rank"), "l_lat", "l_lon")).alias("_l"))
    named = middle.join(best, "area_id", "left")
    return named.withColumns({"lat": F.coalesce("_l.l_lat", "lat"), "lon": F.coalesce("_l.l_lon", "lon")}).drop("_l")


def crosses(lat: Column, lon: Column) -> Column:
    """Whether an edge crosses the ray from a point to the east."""
    a_lat, a_lon, b_lat, b_lon = (F.col(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon"))
    at = F.when(a_lat != b_lat, (b_lon - a_lon) * (lat - a_lat) / (b_lat - a_lat) + a_lon)
    return ((a_lat > lat) != (b_lat > lat)) & (lon < at)


def in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points (point_id, lat, lon) with each box (area_id, south, north, west, east and more) that holds them, borders included.

    A box lies in cells about as wide as itself, four at most, so that a country is no more rows than a quarter; points are looked up in
    the cells of each level: an equi-join. A box over the antimeridian must come as two.
    """
    wide = lambda level: F.lit(CELL) * F.pow(F.lit(float(WIDER)), level)
    side = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"))
    level = F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.ceil(F.log(float(WIDER), F.greatest(side, F.lit(1e-9)) / CELL)))).cast("int")
    cell = lambda c: F.floor(F.col(c) / wide(F.col("_level")))
    dealt = boxes.withColumn("_level", level).withColumn("_y", F.explode(F.sequence(cell("south"), cell("north")))).withColumn("_x", F.explode(F.sequence(cell("west"), cell("east"))))
    placed = points.select("point_id", "lat", "lon", F.explode(F.array(*map(F.lit, range(LEVELS)))).alias("_level")).withColumns({"_y": cell("lat"), "_x": cell("lon")})
    near = placed.join(dealt, ["_level", "_y", "_x"]).drop("_level", "_y", "_x")
    return near.where(F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east")))


def holding(points: DataFrame, edges: DataFrame) -> DataFrame:
    """``point_id``, ``area_id``: the areas that hold each point, by the even-odd rule.

    points: point_id, lat, lon. Points meet boxes in cells, then the area's edges in bands of latitude: two equi-joins, and a count per
    point and area. Points on a southern or western border are inside, on others not. An area over the antimeridian must come as two.
    """
    band = lambda c: F.floor(c / BAND)
    near = in_boxes(points, shapes(edges).select("area_id", "south", "north", "west", "east"))
    near = near.select("point_id", "lat", "lon", "area_id", band(F.col("lat")).alias("_band"))
    dealt = edges.withColumn("_band", F.explode(F.sequence(band(F.least("a_lat", "b_lat")), band(F.greatest("a_lat", "b_lat")))))
    crossed = near.join(dealt, ["area_id", "_band"]).where(crosses(F.col("lat"), F.col("lon")))
    return crossed.groupBy("point_id", "area_id").agg(F.count("*").alias("n")).where("n % 2 = 1").select("point_id", "area_id")
