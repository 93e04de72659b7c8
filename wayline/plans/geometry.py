"""Queries on lines and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from wayline.functions import geo
from wayline.operators import distance, linear
from wayline.operators.order import upper_median
from wayline.plans.base import SEGMENTS, bearing, foot, haversine, query
from wayline.sources.tables import pings, shape_points, stop_legs

SQL_LAST = ("lag(lat) over w", "lag(lon) over w", "lat", "lon")
SQL_LEG = "from stop_leg window w as (partition by route_id, direction order by seq)"


def leg() -> WindowSpec:
    return Window.partitionBy("route_id", "direction").orderBy("seq")


def hop() -> list[Column]:
    """The places of the stop before and of this one."""
    return [F.lag("lat").over(leg()), F.lag("lon").over(leg()), F.col("lat"), F.col("lon")]


@query("g01_haversine", f"select stop_id, round({haversine(*SQL_LAST)}, 3) as metres {SQL_LEG}")
def g01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_legs(spark, sf_dir).select("stop_id", F.round(geo.haversine(*hop()), 3).alias("metres"))


@query("g03_flat_metres", f"select stop_id, round(sqrt(pow((lon - lag(lon) over w)*111320e0*cos(radians((lat + lag(lat) over w)/2)), 2) + pow((lat - lag(lat) over w)*111320e0, 2)), 3) as metres {SQL_LEG}")
def g03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_legs(spark, sf_dir).select("stop_id", F.round(geo.flat_metres(*hop()), 3).alias("metres"))


@query("g04_bearing", f"select stop_id, round({bearing(*SQL_LAST)}, 6) as degrees {SQL_LEG}")
def g04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_legs(spark, sf_dir).select("stop_id", F.round(geo.bearing(*hop()), 6).alias("degrees"))


@query("g05_angle_between", "select event_id, least(d, 360 - d) as angle from (select event_id, cast(((event_id*37 - user_id*91) % 360 + 360) % 360 as double) as d from events)")
def g05(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pings(spark, sf_dir)
    return p.select("event_id", geo.angle_between((F.col("event_id") * 37).cast("double"), (F.col("plate") * 91).cast("double")).alias("angle"))


@query("g06_measured_segments", f"{SEGMENTS} select route_id, seg, round(cum_a, 3) as cum_a, round(cum_b, 3) as cum_b, round(scale, 3) as scale from seg")
def g06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.segments(shape_points(spark, sf_dir)).select("route_id", "seg", *(F.round(c, 3).alias(c) for c in ("cum_a", "cum_b", "scale")))


@query("w01_cumulative", f"{SEGMENTS} select route_id, i, round(along, 3) as along from cum")
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.cumulative(shape_points(spark, sf_dir)).select("route_id", "i", F.round("along", 3).alias("along"))


NEAREST = f"""{SEGMENTS}, pair as (select p.event_id, p.lat as p_lat, p.lon as p_lon, s.* from ping p join seg s using (route_id)), {foot("p_lat", "p_lon")},
best as (select *, row_number() over (partition by event_id order by round(off, 3), seg) as n from placed where off <= 250)
select event_id, route_id, seg, round(along, 3) as along, round(off, 3) as metres_off from best where n = 1"""


@query("j07_project", NEAREST)
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linear.project(pings(spark, sf_dir), linear.segments(shape_points(spark, sf_dir)), 250)
    return found.select("event_id", "route_id", "seg", F.round("along", 3).alias("along"), F.round("offset", 3).alias("metres_off"))


@query("g07_project_in_range", NEAREST.replace("where off <= 250", "where off <= 250 and round(along, 3) between 500 and 4000"))
def g07(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = linear.segments(shape_points(spark, sf_dir)).where("cum_b >= 500 and cum_a <= 4000")
    both = linear.near_segments(pings(spark, sf_dir), segs, 250).where(F.round("along", 3).between(500, 4000))
    best = both.groupBy("event_id", "route_id").agg(F.min(F.struct(F.round("offset", 3).alias("o"), "seg", F.round("along", 3).alias("a"))).alias("b"))
    return best.select("event_id", "route_id", "b.seg", F.col("b.a").alias("along"), F.col("b.o").alias("metres_off"))


def chain_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops of a route's round trip in order."""
    return stop_legs(spark, sf_dir).select("route_id", F.when(F.col("direction") == 1, F.col("seq")).otherwise(1_000_000 + F.col("seq")).alias("ord"), "lat", "lon")


def forward_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_points(spark, sf_dir).withColumn("i", F.abs("i"))


#: The forward match as a fold over each route's stops; of a step's segments the first of least score.
CHAIN = SEGMENTS.replace("with hop as", "with recursive hop as").replace("from shape_pt window", "from (select route_id, abs(i) as i, lat, lon from shape_pt) forward window") + """,
chain as (select route_id, ord, lat, lon, row_number() over (partition by route_id order by ord) as n
  from (select route_id, case when direction = 1 then seq else 1000000 + seq end as ord, lat, lon from stop_leg) o),
run as (
  select distinct route_id, cast(0 as bigint) as n, cast(null as bigint) as ord, 0e0 as along, 0e0 as off from chain
  union all
  select route_id, n, ord, case when isinf(score) then previous else along end, case when isinf(score) then 'infinity'::double else off end
  from (
    select *, row_number() over (partition by route_id order by score, seg) as r
    from (
      select *, case when along >= previous - 60 then round(off + 0.02e0*greatest(0e0, along - previous), 6) else 'infinity'::double end as score
      from (
        select *, cum_a + t*(cum_b - cum_a) as along, sqrt(pow(px - bx*t, 2) + pow(py - by_*t, 2)) as off
        from (
          select *, case when bx*bx + by_*by_ = 0 then 0e0 else greatest(0e0, least(1e0, (px*bx + py*by_)/(bx*bx + by_*by_))) end as t
          from (
            select c.route_id, c.n, c.ord, run.along as previous, s.seg, s.cum_a, s.cum_b, (s.b_lon - s.a_lon)*s.scale as bx, (s.b_lat - s.a_lat)*111320e0 as by_,
              (c.lon - s.a_lon)*s.scale as px, (c.lat - s.a_lat)*111320e0 as py
            from run join chain c on c.route_id = run.route_id and c.n = run.n + 1 join seg s on s.route_id = c.route_id) p) q) u) v) w
  where r = 1)"""


@query("g08_match_chain", f"{CHAIN} select route_id, ord, round(along, 3) as along, round(off, 3) as metres_off from run where n > 0")
def g08(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linear.match_chain(chain_of(spark, sf_dir), linear.segments(forward_points(spark, sf_dir)))
    return found.select("route_id", "ord", F.round("along", 3).alias("along"), F.round("offset", 3).alias("metres_off"))


BOTH_WAYS = CHAIN.replace(
    "from (select route_id, abs(i) as i, lat, lon from shape_pt) forward", "from (select route_id*2 + rev as route_id, case when rev = 1 then -i else i end as i, lat, lon from shape_pt, (values (0), (1)) r(rev)) forward"
).replace("from stop_leg) o)", "from (select s.* exclude (route_id), route_id*2 + rev as route_id from stop_leg s, (values (0), (1)) r(rev)) stop_leg) o)")


@query("g10_align", f"""{BOTH_WAYS},
cost as (select route_id // 2 as route_id, route_id % 2 as reversed, round(sum(least(off, 500e0)), 3) as cost from run where n > 0 group by run.route_id)
select route_id, cast(arg_min(reversed, {{'c': cost, 'r': reversed}}) as int) as reversed, min(cost) as cost from cost group by route_id""")
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.align(shape_points(spark, sf_dir), chain_of(spark, sf_dir))


@query("a06_bands", f"""{CHAIN} select route_id, case when ord < 1000000 then 1 else 2 end as direction, round(min(along), 3) as first, round(max(along), 3) as last,
  round(list_sort(list(off))[cast(floor(count(*)/2e0) as bigint) + 1], 3) as fit from run where n > 0 group by all""")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of places along the line, and the fit, of each direction."""
    found = linear.match_chain(chain_of(spark, sf_dir), linear.segments(forward_points(spark, sf_dir)))
    found = found.withColumn("direction", F.when(F.col("ord") < 1_000_000, 1).otherwise(2))
    ends = found.groupBy("route_id", "direction").agg(F.round(F.min("along"), 3).alias("first"), F.round(F.max("along"), 3).alias("last"))
    return ends.join(upper_median(found, ["route_id", "direction"], "offset", "fit"), ["route_id", "direction"]).withColumn("fit", F.round("fit", 3))


@query("g11_bearing_at_along", f"""{SEGMENTS}, spot as (select distinct route_id, (route_id*131) % 3000 + 0e0 as a from stop_leg),
hit as (select s.*, a, row_number() over (partition by s.route_id order by case when cum_b >= a then 0 else 1 end, case when cum_b >= a then seg else -seg end) as n from seg s join spot using (route_id))
select route_id, a as along, round({bearing("a_lat", "a_lon", "b_lat", "b_lon")}, 6) as degrees from hit where n = 1""")
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = linear.segments(shape_points(spark, sf_dir)).withColumn("a", (F.col("route_id") * 131 % 3000).cast("double"))
    reached = F.col("cum_b") >= F.col("a")
    first = distance.first_by(segs, ["route_id"], F.when(reached, 0).otherwise(1), F.when(reached, F.col("seg")).otherwise(-F.col("seg")))
    return first.select("route_id", F.col("a").alias("along"), F.round(geo.bearing(*map(F.col, ("a_lat", "a_lon", "b_lat", "b_lon"))), 6).alias("degrees"))


@query("g12_slice_line", f"""{SEGMENTS}, span as (select distinct route_id, 100 + route_id*10e0 as a, 900 + route_id*17e0 as b from stop_leg),
hit as (select s.*, a, b, greatest(a, cum_a) as lo, least(b, cum_b) as hi from seg s join span using (route_id) where cum_b > a and cum_a < b and cum_b > cum_a),
pt as (select route_id, seg, 0 as k, a_lat + (b_lat-a_lat)*(lo-cum_a)/(cum_b-cum_a) as lat, a_lon + (b_lon-a_lon)*(lo-cum_a)/(cum_b-cum_a) as lon from hit where cum_a <= a
union all select route_id, seg, 1, a_lat + (b_lat-a_lat)*(hi-cum_a)/(cum_b-cum_a), a_lon + (b_lon-a_lon)*(hi-cum_a)/(cum_b-cum_a) from hit)
select route_id as span_id, row_number() over (partition by route_id order by seg, k) - 1 as ord, round(lat, 6) as lat, round(lon, 6) as lon from pt""")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("route_id")
    spans = stop_legs(spark, sf_dir).select("route_id").distinct().select("route_id", r.alias("span_id"), (r * F.lit(10.0) + 100).alias("start"), (r * F.lit(17.0) + 900).alias("stop"))
    found = linear.slice_line(linear.segments(shape_points(spark, sf_dir)), spans)
    return found.select("span_id", "ord", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("g13_forward_distance", "select event_id, case when b >= a then b - a else b - a + 10000 end as metres from (select event_id, (event_id*131) % 10000 as a, (event_id*733) % 10000 as b from events)")
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("event_id") * 131 % 10000, F.col("event_id") * 733 % 10000
    return pings(spark, sf_dir).select("event_id", F.when(b >= a, b - a).otherwise(b - a + 10000).alias("metres"))


@query("g18_tile", "select stop_id, cast(floor((lon+180)/360*16384) as bigint) as x, cast(floor((1-ln(tan(radians(lat))+1/cos(radians(lat)))/3.141592653589793)/2*16384) as bigint) as y from stop_leg")
def g18(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.tile(F.col("lat"), F.col("lon"), 14)
    return stop_legs(spark, sf_dir).select("stop_id", x.alias("x"), y.alias("y"))


@query("g19_coordinate_deltas", "select stop_id, cast(floor((lat-41.5e0)*1e5+0.5e0) as bigint) as dy, cast(floor((lon-41.5e0)*1e5+0.5e0) as bigint) as dx, round(41.5e0 + floor((lat-41.5e0)*1e5+0.5e0)/1e5, 6) as lat from stop_leg")
def g19(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c: geo.nearest_whole((F.col(c) - 41.5) * 1e5)
    return stop_legs(spark, sf_dir).select("stop_id", part("lat").alias("dy"), part("lon").alias("dx"), F.round(F.lit(41.5) + part("lat") / 1e5, 6).alias("lat"))


@query("g20_interpolate", f"{SEGMENTS} select route_id, seg, round(a_lat + (b_lat-a_lat)*0.25e0, 6) as lat, round(a_lon + (b_lon-a_lon)*0.25e0, 6) as lon from seg")
def g20(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c: F.round(F.col(f"a_{c}") + (F.col(f"b_{c}") - F.col(f"a_{c}")) * 0.25, 6).alias(c)
    return linear.segments(shape_points(spark, sf_dir)).select("route_id", "seg", part("lat"), part("lon"))


@query("g21_halo", "select event_id, least(coalesce(case when value < 20 then null else value*10 end, 750e0), 750e0) as metres, value < 20 or value*10 > 300 as coarse from events")
def g21(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayline.sources.tables import table

    accuracy = F.when(F.col("value") >= 20, F.col("value") * 10)
    return table(spark, sf_dir, "events").select("event_id", F.least(F.coalesce(accuracy, F.lit(750.0)), F.lit(750.0)).alias("metres"), (accuracy.isNull() | (accuracy > 300)).alias("coarse"))


@query("a14_bounds", "select route_id, min(lat) as south, max(lat) as north, min(lon) as west, max(lon) as east from stop_leg group by route_id")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_legs(spark, sf_dir).groupBy("route_id").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))


@query("a12_centre_stop", f"""with c as (select route_id, avg(lat) as clat, avg(lon) as clon from stop_leg group by route_id),
d as (select stop_id, route_id, row_number() over (partition by route_id order by round({haversine("lat", "lon", "clat", "clon")}, 2), stop_id) as n from stop_leg join c using (route_id))
select route_id, stop_id from d where n = 1""")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stop nearest to the mean of a route's stops."""
    stops = stop_legs(spark, sf_dir)
    centre = stops.groupBy("route_id").agg(F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"))
    far = F.round(geo.haversine(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")), 2)
    return stops.join(centre, "route_id").groupBy("route_id").agg(F.min(F.struct(far.alias("d"), "stop_id")).alias("b")).select("route_id", "b.stop_id")


@query("j08_footpaths", f"select a.stop_id, b.stop_id as to_stop, round({haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) as metres from stop_leg a join stop_leg b on a.stop_id <> b.stop_id and abs(a.lat-b.lat) < 0.005 and abs(a.lon-b.lon) < 0.007 and {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 400")
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = stop_legs(spark, sf_dir)
    right = stops.select(F.col("stop_id").alias("to_stop"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    return distance.within(stops.select("stop_id", "lat", "lon"), right, 400).where("stop_id <> to_stop").select("stop_id", "to_stop", F.round("metres", 3).alias("metres"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place per supplier, some of them out of town."""
    from wayline.sources.tables import table

    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(key.alias("point_id"), (F.lit(41.48) + key * 17 % 100 * F.lit(0.0013)).alias("lat"), (F.lit(41.48) + key * 29 % 100 * F.lit(0.0017)).alias("lon"))


POINTS = "point as (select s_suppkey as point_id, 41.48e0 + ((s_suppkey*17) % 100)*0.0013e0 as lat, 41.48e0 + ((s_suppkey*29) % 100)*0.0017e0 as lon from supplier)"
REACH = f"""with {POINTS}, d as (select point_id, stop_id, {haversine('p.lat', 'p.lon', 's.lat', 's.lon')} as metres from point p, stop_leg s),
r as (select *, count(*) filter (where metres <= 1200) over (partition by point_id) as near, row_number() over (partition by point_id order by round(metres, 3), stop_id) as n from d where metres <= 3000)"""


@query("j10_access", f"{REACH} select point_id, stop_id, round(metres, 3) as metres from r where (near > 0 and metres <= 1200) or (near = 0 and n <= 3)")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = stop_legs(spark, sf_dir).select("stop_id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    return distance.access(points(spark, sf_dir), right).select("point_id", "stop_id", F.round("metres", 3).alias("metres"))


@query("o06_nearest_twelve", f"{REACH} select point_id, stop_id, n as place from r where metres <= 1200 and n <= 12")
def o06(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = stop_legs(spark, sf_dir).select("stop_id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    near = distance.within(points(spark, sf_dir), right, 1200)
    place = F.row_number().over(Window.partitionBy("point_id").orderBy(F.round("metres", 3), "stop_id"))
    return near.withColumn("place", place.cast("bigint")).where("place <= 12").select("point_id", "stop_id", "place")


@query("f11_near_network", f"{REACH} select p.point_id, exists (select 1 from stop_leg s where {haversine('p.lat', 'p.lon', 's.lat', 's.lon')} <= 1000) as near from point p")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = stop_legs(spark, sf_dir).select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    p = points(spark, sf_dir)
    near = distance.within(p, right, 1000).select("point_id").distinct().withColumn("near", F.lit(True))
    return p.join(near, "point_id", "left").select("point_id", F.coalesce("near", F.lit(False)).alias("near"))


@query("j24_name_a_point", f"{REACH} select point_id, stop_id from r where n = 1 and metres < 150")
def j24(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = stop_legs(spark, sf_dir).select("stop_id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    near = distance.within(points(spark, sf_dir), right, 150).where("metres < 150")
    return near.groupBy("point_id").agg(F.min(F.struct(F.round("metres", 3).alias("m"), "stop_id")).alias("b")).select("point_id", "b.stop_id")
