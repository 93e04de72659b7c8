"""Queries on areas: a star-shaped one around a point of each supplier."""

from __future__ import annotations

import uuid
from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators import areas, resolve
from wayline.operators.stages import shared_folder
from wayline.plans.base import haversine, query
from wayline.sources import elements
from wayline.sources.tables import stop_legs, table

POINTS, SKIP = 7, 3

EDGES = f"""vertex as (
  select s_suppkey as area_id, k,
    41.5e0 + (s_suppkey*7 % 25)*0.003e0 + (0.004e0 + (s_suppkey % 5)*0.001e0)*cos(2*pi()*{SKIP}*k/{POINTS}) as lat,
    41.5e0 + (s_suppkey*11 % last)*0.003e0 + (0.004e0 + (s_suppkey % 5)*0.001e0)*sin(2*pi()*{SKIP}*k/{POINTS}) as lon
  from supplier, (select max(seq) + 1 as last from stop_leg) l, range({POINTS}) t(k)),
edge as (
  select a.area_id, a.lat as a_lat, a.lon as a_lon, b.lat as b_lat, b.lon as b_lon
  from vertex a join vertex b on b.area_id = a.area_id and b.k = (a.k + 1) % {POINTS}),
inside as (
  select stop_id, area_id, lat, lon from stop_leg join edge on (a_lat > lat) <> (b_lat > lat) and lon < (b_lon - a_lon)*(lat - a_lat)/(b_lat - a_lat) + a_lon
  group by all having count(*) % 2 = 1)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-pointed stars that cross themselves, so their middles are outside by the even-odd rule."""
    last = F.broadcast(stop_legs(spark, sf_dir).agg((F.max("seq") + 1).alias("last")))  # one row
    s = F.col("s_suppkey")
    corner = table(spark, sf_dir, "supplier").crossJoin(last).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))))
    reach = F.lit(0.004) + s % 5 * F.lit(0.001)
    at = lambda k: (F.lit(41.5) + s * 7 % 25 * F.lit(0.003) + reach * F.cos(2 * pi * SKIP * k / POINTS), F.lit(41.5) + s * 11 % F.col("last") * F.lit(0.003) + reach * F.sin(2 * pi * SKIP * k / POINTS))
    (a_lat, a_lon), (b_lat, b_lon) = at(F.col("k")), at((F.col("k") + 1) % POINTS)
    return corner.select(s.alias("area_id"), a_lat.alias("a_lat"), a_lon.alias("a_lon"), b_lat.alias("b_lat"), b_lon.alias("b_lon"))


@query("g14_area_shapes", f"""with {EDGES},
box as (select area_id, min(lat) as south, max(lat) as north, min(lon) as west, max(lon) as east from vertex group by area_id)
select area_id, round(south, 7) as south, round(north, 7) as north, round(west, 7) as west, round(east, 7) as east,
  round(case area_id % 4 when 0 then 41.6e0 when 1 then 41.7e0 else (south + north)/2 end, 7) as lat, round(case when area_id % 4 < 2 then 41.8e0 else (west + east)/2 end, 7) as lon from box""")
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and label points; some areas have a label and an admin centre, some the latter only."""
    s = F.col("s_suppkey")
    one = table(spark, sf_dir, "supplier").select(s.alias("area_id"))
    kinds = (("area_id % 4 = 0", "label", 41.6), ("area_id % 4 < 2", "admin_centre", 41.7), ("area_id % 4 = 2", "subarea", 41.9))
    labels = None
    for where, role, lat in kinds:
        some = one.where(where).select("area_id", F.lit(role).alias("role"), F.lit(lat).alias("l_lat"), F.lit(41.8).alias("l_lon"))
        labels = some if labels is None else labels.unionByName(some)
    found = areas.shapes(edges(spark, sf_dir), labels)
    return found.select("area_id", *(F.round(c, 7).alias(c) for c in ("south", "north", "west", "east", "lat", "lon")))


@query("g15_areas_of_stops", f"with {EDGES} select stop_id, area_id from inside")
def g15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas.holding(stop_legs(spark, sf_dir).select(F.col("stop_id").alias("point_id"), "lat", "lon"), edges(spark, sf_dir)).select(F.col("point_id").alias("stop_id"), "area_id")


@query("j14_point_in_polygon", f"with {EDGES} select stop_id, stop_id in (select stop_id from inside) as inside from stop_leg")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a stop is in any area."""
    stops = stop_legs(spark, sf_dir).select(F.col("stop_id").alias("point_id"), "lat", "lon")
    held = areas.holding(stops, edges(spark, sf_dir)).select("point_id").distinct().withColumn("inside", F.lit(True))
    return stops.join(held, "point_id", "left").select(F.col("point_id").alias("stop_id"), F.coalesce("inside", F.lit(False)).alias("inside"))


FAR = haversine("s.lat", "s.lon", "v.lat", "v.lon")


@query("j15_localities_by_border", f"""with {EDGES},
held as (select *, row_number() over (partition by stop_id order by level desc, area_id) as r from (select stop_id, area_id, 6 + area_id % 3 * 2 as level from inside) i),
near as (select s.stop_id, v.stop_id as village, row_number() over (partition by s.stop_id order by round({FAR}, 3), v.stop_id) as r from stop_leg s join stop_leg v on v.stop_id % 40 = 0 and {FAR} <= 700)
select s.stop_id, cast(coalesce(case when h.level >= 8 then h.area_id end, n.village, h.area_id, -1) as bigint) as area_id
from stop_leg s left join held h on h.stop_id = s.stop_id and h.r = 1 left join near n on n.stop_id = s.stop_id and n.r = 1""")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts and towns before villages nearby, and these before municipalities."""
    stops = stop_legs(spark, sf_dir)
    levels = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("area_id"), (6 + F.col("s_suppkey") % 3 * 2).alias("level"))
    villages = stops.where("stop_id % 40 = 0").select(F.col("stop_id").alias("area_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    found = resolve.localities_of_areas(stops.select(F.col("stop_id").alias("point_id"), "lat", "lon"), edges(spark, sf_dir), levels, villages, 700)
    return found.select(F.col("point_id").alias("stop_id"), "area_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network as map elements, written as documents and read back: stops as nodes, directions as ways, lines as areas of both.

    Every fifth way carries its geometry, the others name their nodes; every eleventh node is missing; a line's ways are its border,
    the second one backwards, and a label and an admin centre name nodes of the first.
    """
    stops = stop_legs(spark, sf_dir).withColumn("way_id", F.col("route_id") * 2 + F.col("direction"))
    point = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    node = stops.where("stop_id % 11 > 0").select(F.lit("node").alias("type"), F.col("stop_id").alias("id"), "lat", "lon", F.create_map(F.lit("name"), F.concat(F.lit("Stop "), "stop_id")).alias("tags"), F.col("route_id").alias("line"))
    chain = F.sort_array(F.collect_list(F.struct("seq", "stop_id", "lat", "lon")))  # of one direction
    way = stops.groupBy("route_id", "way_id").agg(chain.alias("c"), F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"))
    inline = F.col("way_id") % 5 == 0
    way = way.select(
        F.lit("way").alias("type"), F.col("way_id").alias("id"), point(F.col("c_lat"), F.col("c_lon")).alias("center"), F.when(~inline, F.transform("c", lambda x: x["stop_id"])).alias("nodes"),
        F.when(inline, F.transform("c", lambda x: point(x["lat"], x["lon"]))).alias("geometry"), F.col("route_id").alias("line"),
    )
    member = lambda kind, ref, role: F.struct(F.lit(kind).alias("type"), ref.cast("bigint").alias("ref"), F.lit(role).alias("role"))
    line = F.col("route_id")
    relation = stops.select("route_id").distinct().select(
        F.lit("relation").alias("type"), line.alias("id"),
        F.array(member("node", line, "admin_centre"), member("way", line * 2 + 2, "inner"), member("way", line * 2 + 1, "outer"), member("way", line * 2 + 2, "part"), member("node", line + 25, "label"), member("node", line + 50, "label")).alias("members"),
        line.alias("line"),
    )
    every = node.unionByName(way, allowMissingColumns=True).unionByName(relation, allowMissingColumns=True)
    fields = [c for c in every.columns if c != "line"]
    at = f"{shared_folder(spark)}/elements-{uuid.uuid4().hex}"
    every.groupBy("line", (F.xxhash64("type", "id") % 7).alias("part")).agg(F.collect_list(F.struct(*fields)).alias("elements")).select("elements").write.json(at)  # small documents
    return elements.read_elements(spark, at)


ELEMENTS = """leg as (select *, route_id*2 + direction as way_id, (route_id*2 + direction) % 5 = 0 as inline from stop_leg),
vertex as (select way_id, route_id, seq as i, lat, lon from leg where inline or stop_id % 11 > 0),
hop as (select way_id, route_id, i, lag(i) over w as before, lag(lat) over w as a_lat, lag(lon) over w as a_lon, lat as b_lat, lon as b_lon from vertex window w as (partition by way_id order by i)),
border as (select route_id as area_id, case when way_id % 2 = 0 then 1 else 2 end as member, i, a_lat, a_lon, b_lat, b_lon from hop where before = i - 1),
named as (select route_id as area_id, stop_id, lat, lon, case when stop_id >= 50 then 0 when stop_id >= 25 then 1 else 2 end as rank from stop_leg where stop_id < 75 and stop_id % 11 > 0)"""


@query("s09_area_edges", f"with {ELEMENTS} select * from border")
def s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the lines' borders, from documents whose relations name ways and whose ways name nodes."""
    return elements.area_edges(documents(spark, sf_dir))


@query("s09_area_shapes", f"""with {ELEMENTS}, box as (select area_id, min(least(a_lat, b_lat)) as south, max(greatest(a_lat, b_lat)) as north, min(least(a_lon, b_lon)) as west, max(greatest(a_lon, b_lon)) as east from border group by area_id),
label as (select area_id, arg_min(lat, rank) as lat, arg_min(lon, rank) as lon from named group by area_id)
select area_id, round(south, 7) as south, round(north, 7) as north, round(west, 7) as west, round(east, 7) as east, round(coalesce(label.lat, (south + north)/2), 7) as lat, round(coalesce(label.lon, (west + east)/2), 7) as lon from box left join label using (area_id)""")
def s09_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and label points of the same areas."""
    found = documents(spark, sf_dir)
    return areas.shapes(elements.area_edges(found), elements.area_labels(found)).select("area_id", *(F.round(c, 7).alias(c) for c in ("south", "north", "west", "east", "lat", "lon")))


@query("s09_places", """select * from (
  select 'node' as type, stop_id as id, round(lat, 7) as lat, round(lon, 7) as lon, 2 as rank, 'Stop ' || stop_id as name from stop_leg where stop_id % 11 > 0
  union all select 'way', route_id*2 + direction, round(avg(lat), 7), round(avg(lon), 7), 0, null from stop_leg group by route_id, direction) where lat between 41.5 and 41.56 and lon between 41.5 and 41.53""")
def s09_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements inside a box, by their centre or their own place."""
    found = elements.places(documents(spark, sf_dir), 41.5, 41.5, 41.56, 41.53)
    return found.select("type", "id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.col("rank").cast("int").alias("rank"), F.try_element_at("tags", F.lit("name")).alias("name"))
