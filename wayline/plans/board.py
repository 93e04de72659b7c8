"""Queries on timetables, vehicles and arrival boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions import clock, geo
from wayline.operators import distance, fleet, linear, order, timetable
from wayline.plans.base import bearing, haversine, query
from wayline.sources.reads import Reads
from wayline.sources.tables import departures, pings, running_times, stop_legs

LEG = ["route_id", "direction"]
NOW = 480


def along_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops with ``along``, metres from their direction's first stop, to the millimetre."""
    stops = stop_legs(spark, sf_dir)
    line = Window.partitionBy(*LEG).orderBy("seq")
    hop = F.coalesce(geo.haversine(F.lag("lat").over(line), F.lag("lon").over(line), F.col("lat"), F.col("lon")), F.lit(0.0))
    return stops.withColumn("hop", hop).withColumn("along", F.round(F.sum("hop").over(line.rowsBetween(Window.unboundedPreceding, 0)), 3)).drop("hop")


STOPS = f"""with along0 as (select *, coalesce({haversine("lag(lat) over w", "lag(lon) over w", "lat", "lon")}, 0e0) as hop from stop_leg window w as (partition by route_id, direction order by seq)),
stop as (select stop_id, route_id, direction, seq, lat, lon, round(sum(hop) over (partition by route_id, direction order by seq rows unbounded preceding), 3) as along from along0)"""


def stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled time lists of each stop: leg, seq, times."""
    both = running_times(spark, sf_dir).join(departures(spark, sf_dir), "route_id")
    return both.groupBy(*LEG, "seq").agg(F.sort_array(F.collect_list(clock.to_clock(F.col("dep") + F.col("off")))).alias("times"))


TIMES = "stop_minute as (select route_id, direction, seq, dep + off as minute from offs join dep using (route_id) where (select max(off) from offs) < 240)"


@query("w03_trip_minutes", f"with {TIMES} select route_id, direction, seq, row_number() over (partition by route_id, direction, seq order by minute) - 1 as k, cast(minute as bigint) as minute from stop_minute")
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timetable.trips(stop_times(spark, sf_dir))


@query("a04_trip_patterns", f"""with {TIMES}, trip as (select route_id, direction, seq, minute, row_number() over (partition by route_id, direction, seq order by minute) as k from stop_minute),
o as (select route_id, direction, k, min(minute) as dep, list(minute - first_minute order by seq) as offsets from (select *, first_value(minute) over (partition by route_id, direction, k order by seq) as first_minute from trip) group by all)
select route_id, direction, len(offsets) as n_stops, list_last(offsets) as minutes, count(*) as n_trips, min(dep) as first, max(dep) as last from o group by route_id, direction, offsets""")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = timetable.patterns(stop_times(spark, sf_dir))
    return p.select(*LEG, F.size("offsets").cast("bigint").alias("n_stops"), F.element_at("offsets", -1).alias("minutes"), F.size("departures").cast("bigint").alias("n_trips"), F.element_at("departures", 1).alias("first"), F.element_at("departures", -1).alias("last"))


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leg with parallel arrays of seq, offsets and along."""
    both = running_times(spark, sf_dir).join(along_stops(spark, sf_dir).select(*LEG, "seq", "along"), [*LEG, "seq"])
    rows = both.groupBy(*LEG).agg(F.sort_array(F.collect_list(F.struct("seq", "off", "along"))).alias("s"))
    return rows.select(*LEG, *(F.col(f"s.{c}").alias(c) for c in ("seq", "off", "along")))


SPEEDS = f"""{STOPS}, ends as (select route_id, direction, arg_max(off, seq) as minutes, max(along) - min(along) as metres from offs join stop using (route_id, direction, seq) group by route_id, direction),
speed as (select *, case when minutes > 0 then metres/1000/(minutes/60.0) else 'inf'::double end as kmh from ends)"""


@query("f13_plausible_speeds", f"{SPEEDS} select route_id, direction, round(kmh, 3) as kmh from speed where kmh > 0 and kmh <= 45")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = legs(spark, sf_dir).select(*LEG, timetable.pattern_speed(F.col("off"), F.col("along")).alias("kmh"))
    return rows.where((F.col("kmh") > 0) & (F.col("kmh") <= 45)).select(*LEG, F.round("kmh", 3).alias("kmh"))


@query("a02_usual_speed", f"{SPEEDS} select round(coalesce((select list_sort(list(kmh))[cast(floor(count(*)/2) as bigint)+1] from speed where kmh > 0 and kmh <= 45), 18), 3) as kmh")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timetable.usual_speed(legs(spark, sf_dir).select(timetable.pattern_speed(F.col("off"), F.col("along")).alias("kmh"))).select(F.round("kmh", 3).alias("kmh"))


@query("w05_repair", f"""with recursive {STOPS[5:]}, leg as (select route_id, direction, list(off order by seq) as o, list(along order by seq) as a from offs join stop using (route_id, direction, seq) group by route_id, direction),
run as (select route_id, direction, o, a, 1 as s, [o[1]] as r from leg
  union all select route_id, direction, o, a, s + 1, list_append(r, greatest(o[s+1], cast(ceil(round(list_max(list_transform(range(1, s+1), lambda b: r[b] + greatest(0, a[s+1]-a[b])/1000)) - 2, 6)) as bigint))) from run where s < len(o)),
done as (select *, len(o) > 1 and a[-1] - a[1] > 0 and (o[-1] <= 0 or (a[-1]-a[1])/o[-1] > 750) as anew from run where s = len(o)),
each as (select route_id, direction, unnest(range(1, len(o)+1)) as k, o, a, r, anew from done)
select route_id, direction, k - 1 as seq, cast(case when anew then floor(greatest(0, a[k]-a[1])/(18e0*1000/60)+0.5e0) else r[k] end as bigint) as minutes, case when anew then k > 1 else r[k] <> o[k] end as estimated from each""")
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = legs(spark, sf_dir).withColumn("new", timetable.repaired(F.col("off"), F.col("along"), F.lit(18.0)))
    span, total = F.element_at("along", -1) - F.element_at("along", 1), F.element_at("off", -1)
    new = new.withColumn("anew", (span > 0) & ((total <= 0) | (span / total > 750)))
    rows = new.select(*LEG, "anew", F.posexplode(F.arrays_zip("seq", "off", "new")).alias("k", "x"))
    return rows.select(*LEG, "x.seq", F.col("x.new").alias("minutes"), F.when(F.col("anew"), F.col("k") > 0).otherwise(F.col("x.new") != F.col("x.off")).alias("estimated"))


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted minutes of each stop."""
    both = stop_legs(spark, sf_dir).join(running_times(spark, sf_dir), [*LEG, "seq"]).join(departures(spark, sf_dir), "route_id")
    return both.groupBy("stop_id", *LEG, "seq").agg(F.sort_array(F.collect_set((F.col("dep") + F.col("off")) % 1440)).alias("minutes"))


SCHEDULE = "minute as (select distinct stop_id, route_id, direction, seq, (dep + off) % 1440 as m from stop_leg join offs using (route_id, direction, seq) join dep using (route_id))"
NEXT = f"next as (select stop_id, route_id, direction, coalesce(min(m) filter (where m >= {NOW}) - {NOW}, 1440 - {NOW} + min(m)) as wait from minute group by all)"


@query("t04_next_scheduled", f"with {SCHEDULE}, {NEXT} select stop_id, cast(wait as bigint) as wait from next")
def t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(spark, sf_dir).select("stop_id", clock.next_departure(F.col("minutes"), F.lit(NOW)).cast("bigint").alias("wait"))


@query("f08_upcoming_times", f"""with {SCHEDULE}, later as (select *, m >= {NOW} as ahead, max(m) over (partition by stop_id) >= {NOW} as any_ahead from minute),
n as (select *, row_number() over (partition by stop_id order by m) as place from later where ahead or not any_ahead) select stop_id, place, cast(m as bigint) as minute from n where place <= 6""")
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.filter("minutes", lambda m: m >= NOW)
    shown = F.slice(F.when(F.size(later) > 0, later).otherwise(F.col("minutes")), 1, 6)
    return schedule(spark, sf_dir).select("stop_id", F.posexplode(shown).alias("k", "minute")).select("stop_id", (F.col("k") + 1).cast("bigint").alias("place"), F.col("minute").cast("bigint").alias("minute"))


@query("a10_headway", f"""with {SCHEDULE}, g as (select stop_id, m, m - lag(m) over (partition by stop_id order by m) as gap from minute),
a as (select stop_id, count(*) as n, min(m) as first, max(m) as last, min(gap) filter (where gap > 0) as least, max(gap) filter (where gap > 0) as most, avg(gap) filter (where gap > 0) as mean from g group by stop_id)
select stop_id, case when n < 3 then 'span' when most - least <= 2 then 'every ' || cast(floor(mean + 0.5) as bigint) else least || '-' || most end as headway, cast(first as bigint) as first, cast(last as bigint) as last from a""")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = schedule(spark, sf_dir).select("stop_id", F.explode("minutes").alias("m"))
    gap = F.col("m") - F.lag("m").over(Window.partitionBy("stop_id").orderBy("m"))
    rows = each.withColumn("gap", F.when(gap > 0, gap)).groupBy("stop_id").agg(F.count("*").alias("n"), F.min("m").alias("first"), F.max("m").alias("last"), F.min("gap").alias("least"), F.max("gap").alias("most"), F.avg("gap").alias("mean"))
    text = F.when(F.col("n") < 3, "span").when(F.col("most") - F.col("least") <= 2, F.concat(F.lit("every "), geo.nearest_whole(F.col("mean")).cast("string")))
    return rows.select("stop_id", text.otherwise(F.concat_ws("-", "least", "most")).alias("headway"), F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"))


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sample of each vehicle, with its place along both directions' stops and made-up speed and standing."""
    last = distance.first_by(pings(spark, sf_dir), ["plate"], F.col("event_id").desc())
    e = F.col("event_id")
    return last.select(
        "plate", "route_id", (1 + e % 2).cast("int").alias("direction"), (e * 7919 % 1200 / F.lit(1200.0) * 8000).alias("v_along"),
        F.when(e % 7 > 0, (e * 13 % 50).cast("double")).alias("kmh"), (e * 31 % 400).cast("double").alias("standing"),
    ).where("standing <= 300")


VEHICLES = """vehicle as (select plate, route_id, cast(1 + event_id % 2 as int) as direction, (event_id*7919 % 1200)/1200e0*8000 as v_along,
  case when event_id % 7 > 0 then cast(event_id*13 % 50 as double) end as kmh, cast(event_id*31 % 400 as double) as standing
  from (select *, row_number() over (partition by plate order by event_id desc) as n from ping) t where n = 1 and event_id*31 % 400 <= 300)"""
ASOF = f"""{STOPS}, {VEHICLES}, near as (select s.stop_id, s.route_id, s.direction, s.along, v.* exclude (route_id, direction), s.along - v.v_along as distance,
  row_number() over (partition by s.stop_id order by round(s.along - v.v_along, 3), v.plate) as n from stop s join vehicle v on s.route_id = v.route_id and s.direction = v.direction and s.along - v.v_along >= -40)"""


@query("j05_asof_along", f"{ASOF} select stop_id, plate, cast(floor(greatest(0, distance) + 0.5) as bigint) as metres from near where n = 1")
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fleet.asof_along(along_stops(spark, sf_dir).select(*LEG, "stop_id", "along"), vehicles(spark, sf_dir), LEG)
    return found.select("stop_id", "plate", geo.nearest_whole(F.greatest(F.lit(0.0), F.col("distance"))).alias("metres"))


BETWEEN = f"""{ASOF}, between_ as (select n.stop_id, count(s.stop_id) as stops from near n left join stop s on s.route_id = n.route_id and s.direction = n.direction and s.along > n.v_along and s.along < n.along where n.n = 1 group by n.stop_id)"""


def stops_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of matches with ``between``, the stops strictly between vehicle and stop; counted by rank in one merged order."""
    stops = along_stops(spark, sf_dir).select(*LEG, "stop_id", "along")
    ranked = stops.withColumn("n_before", F.rank().over(Window.partitionBy(*LEG).orderBy("along")) - 1)
    found = fleet.asof_along(ranked, fleet.stops_up_to(stops, vehicles(spark, sf_dir), LEG), LEG)
    return found.withColumn("between", F.greatest(F.col("n_before") - F.col("n_passed"), F.lit(0)).cast("bigint"))


@query("a07_stops_between", f"{BETWEEN} select stop_id, stops from between_")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops_between(spark, sf_dir).select("stop_id", F.col("between").alias("stops"))


SECONDS = "greatest(0, n.distance)/1000/least(45, greatest(10, coalesce(n.kmh, 18)))*3600 + 15*b.stops + greatest(0, n.standing - 45)"
CONFIDENCE = "case when n.standing > 150 or n.kmh is null or n.kmh < 10 then 'slow' else 'live' end"


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stops_between(spark, sf_dir)
    seconds = F.round(fleet.estimate_seconds(F.col("distance"), F.col("kmh"), F.col("between"), F.col("standing")), 3)
    slow = (F.col("standing") > 150) | F.col("kmh").isNull() | (F.col("kmh") < 10)
    return found.withColumn("seconds", seconds).withColumn("confidence", F.when(slow, "slow").otherwise("live")).where("seconds <= 3600")


ESTIMATE = f"{BETWEEN}, estimate as (select n.stop_id, n.plate, round({SECONDS}, 3) as seconds, {CONFIDENCE} as confidence from near n join between_ b using (stop_id) where n.n = 1 and round({SECONDS}, 3) <= 3600)"


@query("ks6_estimates", f"{ESTIMATE} select stop_id, plate, seconds, confidence from estimate")
def ks6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimates(spark, sf_dir).select("stop_id", "plate", "seconds", "confidence")


@query("p11_countdown", f"{ESTIMATE} select stop_id, case when seconds <= 45 then 'approaching' else case when confidence = 'slow' then '~' else '' end || cast(ceil(seconds/60) as bigint) || ' min' end as label from estimate")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimates(spark, sf_dir).select("stop_id", clock.countdown(F.col("seconds"), F.col("confidence")).alias("label"))


@query("board_arrivals", f"""{ESTIMATE}, {SCHEDULE}, {NEXT}, b as (select n.stop_id, n.route_id, n.direction, e.plate, cast(n.wait as bigint) as scheduled, cast(case when e.seconds is not null then greatest(0, floor(e.seconds/60 + 0.5)) end as bigint) as live from next n left join estimate e using (stop_id))
select *, row_number() over (partition by route_id, direction order by coalesce(live, scheduled), stop_id) as place from b""")
def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled and estimated minutes at every stop, soonest first within each direction."""
    wait = schedule(spark, sf_dir).select("stop_id", *LEG, clock.next_departure(F.col("minutes"), F.lit(NOW)).cast("bigint").alias("scheduled"))
    live = estimates(spark, sf_dir).select("stop_id", "plate", F.greatest(F.lit(0), geo.nearest_whole(F.col("seconds") / 60)).cast("bigint").alias("live"))
    both = wait.join(live, "stop_id", "left").select("stop_id", *LEG, "plate", "scheduled", "live")
    place = F.row_number().over(Window.partitionBy(*LEG).orderBy(F.coalesce("live", "scheduled"), "stop_id"))
    return both.withColumn("place", place.cast("bigint"))


def reads(spark: SparkSession, sf_dir: str) -> Reads:
    """The network as a client reads it."""
    last = distance.first_by(pings(spark, sf_dir), ["plate"], F.col("event_id").desc())
    return Reads(stop_legs(spark, sf_dir), board(spark, sf_dir), timetable.patterns(stop_times(spark, sf_dir)), last)


@query("s18_vehicles_of_lines", "select plate, route_id, lat, lon from (select *, row_number() over (partition by plate order by event_id desc) as n from ping) where n = 1 and route_id in (3, 7, 11)")
def s18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).vehicles([3, 7, 11])


@query("s18_stops_and_lines", "select 'stop' as what, stop_id as id, null::bigint as n_stops from stop_leg group by stop_id union all select 'line', route_id, count(distinct stop_id) from stop_leg group by route_id union all select 'stop of line 5', stop_id, null from stop_leg where route_id = 5")
def s18_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lists of stops and lines and a line's page show."""
    network, none = reads(spark, sf_dir), F.lit(None).cast("bigint").alias("n_stops")
    lines = network.routes().select(F.lit("line").alias("what"), F.col("route_id").alias("id"), "n_stops")
    stops = network.stops().select(F.lit("stop").alias("what"), F.col("stop_id").alias("id"), none)
    return stops.unionByName(lines).unionByName(network.route(5).select(F.lit("stop of line 5").alias("what"), F.col("stop_id").alias("id"), none))


@query("j03_headsigns", "with last as (select route_id, direction, max(seq) as s from stop_leg group by route_id, direction), name as (select s.route_id, s.direction, s.stop_id from stop_leg s join last l on s.route_id = l.route_id and s.direction = l.direction and s.seq = l.s and s.route_id % 5 > 0) select s.stop_id, coalesce('Stop ' || n.stop_id, 'Route ' || s.route_id) as headsign from stop_leg s left join name n using (route_id, direction)")
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = stop_legs(spark, sf_dir)
    last = stops.where("route_id % 5 > 0").groupBy(*LEG).agg(F.max_by("stop_id", "seq").alias("end"))
    return stops.join(last, LEG, "left").select("stop_id", F.coalesce(F.concat(F.lit("Stop "), "end"), F.concat(F.lit("Route "), "route_id")).alias("headsign"))


@query("a03_chains", f"{STOPS} select route_id, direction, count(*) as n, string_agg(cast(stop_id as varchar), ',' order by seq) as stop_ids, cast(floor(max(along) + 0.5) as bigint) as metres from stop group by route_id, direction")
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "stop_id"))), lambda x: x["stop_id"]), ",")
    return along_stops(spark, sf_dir).groupBy(*LEG).agg(F.count("*").alias("n"), stops.alias("stop_ids"), geo.nearest_whole(F.max("along")).alias("metres"))


@query("a08_counts", "select route_id, count(*) as n_stops, (select count(distinct plate) from ping p where p.route_id = s.route_id) as n_buses from stop_leg s group by route_id")
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    buses = pings(spark, sf_dir).groupBy("route_id").agg(F.countDistinct("plate").alias("n"))
    return stop_legs(spark, sf_dir).groupBy("route_id").agg(F.count("*").alias("n_stops")).join(buses, "route_id", "left").select("route_id", "n_stops", F.coalesce("n", F.lit(0)).alias("n_buses"))


@query("a01_upper_median", "select o_orderpriority, list_sort(list(o_totalprice))[cast(floor(count(*)/2) as bigint)+1] as middle from orders group by o_orderpriority")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayline.sources.tables import table

    return order.upper_median(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")


@query("w02_planner_minutes", f"{STOPS} select stop_id, round(along*1.08e0, 2) as metres, round(along*1.08e0/(19.6e0*1000/60), 4) as minutes from stop")
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    road = F.col("along") * 1.08
    return along_stops(spark, sf_dir).select("stop_id", F.round(road, 2).alias("metres"), F.round(road / (19.6 * 1000 / 60), 4).alias("minutes"))


TRACK = f"""with recursive x as (select *, row_number() over (partition by plate order by now_ms, event_id) as n from ping),
run as (
  select plate, n, event_id, now_ms, lat, lon, cast(null as double) as heading, cast(null as double) as speed, now_ms as moved, now_ms as seen, now_ms as began from x where n = 1
  union all
  select plate, n, event_id, now_ms,
    case when fresh or gone >= 12 then lat else at_lat end, case when fresh or gone >= 12 then lon else at_lon end,
    case when fresh then null when gone >= 12 then {bearing("at_lat", "at_lon", "lat", "lon")} else heading end,
    case when fresh then null when gone < 12 then speed*pow(0.5e0, (now_ms - seen)/60000e0)
      when speed is null then least(90e0, gone/greatest(1e0, (now_ms - moved)/1000e0)*3.6e0)
      else 0.6e0*speed + 0.4e0*least(90e0, gone/greatest(1e0, (now_ms - moved)/1000e0)*3.6e0) end,
    case when fresh or gone >= 12 then now_ms else moved end, now_ms, case when fresh then now_ms else began end
  from (
    select x.plate, x.n, x.event_id, x.now_ms, x.lat, x.lon, run.lat as at_lat, run.lon as at_lon, run.heading, run.speed, run.moved, run.seen, run.began,
      x.now_ms - run.seen > 3600000 as fresh, {haversine("run.lat", "run.lon", "x.lat", "x.lon")} as gone
    from run join x on x.plate = run.plate and x.n = run.n + 1) step)"""


@query("w08_tracks", f"""{TRACK}
select event_id, plate, now_ms, lat, lon, round(heading, 3) as heading, round(speed, 3) as speed_kmh, moved as moved_ms, seen as seen_ms, began as first_ms from run""")
def w08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each vehicle after every sample."""
    return fleet.track(pings(spark, sf_dir)).withColumns({"heading": F.round("heading", 3), "speed_kmh": F.round("speed_kmh", 3)})


@query("p07_heading_speed", f"""{TRACK}
select event_id, (cast(floor(heading + 0.5e0) as bigint) % 360 + 360) % 360 as heading, cast(floor(speed + 0.5e0) as bigint) as kmh from run""")
def p07(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fleet.track(pings(spark, sf_dir))
    return t.select("event_id", F.pmod(geo.nearest_whole(F.col("heading")), F.lit(360)).alias("heading"), geo.nearest_whole(F.col("speed_kmh")).alias("kmh"))


@query("p08_in_service", f"""{TRACK}
select event_id, (now_ms - moved)/1000e0 < 600 or (now_ms - began)/1000e0 < 120 as in_service, (now_ms - moved)/1000e0 as standing from run""")
def p08(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fleet.track(pings(spark, sf_dir))
    standing, age = (F.col("now_ms") - F.col("moved_ms")) / 1000, (F.col("now_ms") - F.col("first_ms")) / 1000
    return t.select("event_id", fleet.in_service(standing, age).alias("in_service"), standing.alias("standing"))


RAW = "raw as (select event_id % 200 as key, event_id as now_ms, event_id*1000 + ((event_id*7919) % 90000) as raw_ms from events)"


def raw_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return pings(spark, sf_dir).select((e % 200).alias("key"), e.alias("now_ms"), (e * 1000 + e * 7919 % 90000).alias("raw_ms"))


@query("w09_ratchet", f"""with recursive {RAW}, x as (select *, row_number() over (partition by key order by now_ms) as n from raw),
run as (select key, n, now_ms, cast(raw_ms as double) as raw_ms, cast(raw_ms as double) as shown_ms from x where n = 1
 union all select x.key, x.n, x.now_ms, cast(x.raw_ms as double), case when x.raw_ms <= run.shown_ms then x.raw_ms when x.raw_ms - run.shown_ms < 20000 then run.shown_ms else run.shown_ms + 0.25e0*(x.raw_ms - run.shown_ms) end from run join x on x.key = run.key and x.n = run.n + 1)
select key, now_ms, raw_ms, round(shown_ms, 3) as shown_ms from run""")
def w09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.ratchet(raw_instants(spark, sf_dir)).withColumn("shown_ms", F.round("shown_ms", 3))


def fitting_sql() -> str:
    from wayline.plans.geometry import CHAIN

    return f"""{CHAIN}, {TRACK.replace("run", "trk").removeprefix("with recursive ")},
band as (select route_id, case when ord < 1000000 then 1 else 2 end as direction, min(along) as low, max(along) as high from run where n > 0 group by all),
foot as (select event_id, heading, s.*, case when bx*bx + by_*by_ = 0 then 0e0 else greatest(0e0, least(1e0, (px*bx + py*by_)/(bx*bx + by_*by_))) end as t from (
  select event_id, heading, s.*, (b_lon - a_lon)*scale as bx, (b_lat - a_lat)*111320e0 as by_, (lon - a_lon)*scale as px, (lat - a_lat)*111320e0 as py
  from trk join seg s on s.route_id = plate % 25 where heading is not null) s),
side as (select event_id, f.route_id, seg, direction, round(off, 3) as off, abs({bearing("a_lat", "a_lon", "b_lat", "b_lon")} - heading) as d
  from (select *, cum_a + t*(cum_b - cum_a) as along, sqrt(pow(px - bx*t, 2) + pow(py - by_*t, 2)) as off from foot) f join band using (route_id) where off <= 250 and along between low - 400 and high + 400),
nearest as (select event_id, direction, arg_min(least(d, 360 - d), {{'o': off, 's': seg}}) as turn, min(off) as off from side group by event_id, direction)
select event_id, case when min(turn + off/10) is not null and arg_min(turn, {{'s': turn + off/10, 'd': direction}}) <= 70 then arg_min(direction, {{'s': turn + off/10, 'd': direction}}) end as direction from nearest group by event_id"""


@query("j06_direction", fitting_sql())
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direction of each moving vehicle: of its line's two stretches the one whose bearing fits the heading best."""
    from wayline.plans.geometry import chain_of, forward_points

    segs = linear.segments(forward_points(spark, sf_dir))
    bands = linear.match_chain(chain_of(spark, sf_dir), segs).groupBy("route_id", F.when(F.col("ord") < 1_000_000, 1).otherwise(2).alias("direction")).agg(F.min("along").alias("low"), F.max("along").alias("high"))
    moving = fleet.track(pings(spark, sf_dir)).where("heading is not null").withColumn("route_id", F.col("plate") % 25)
    both = linear.near_segments(moving.select("event_id", "route_id", "lat", "lon", "heading"), segs, 250)
    both = both.join(bands, "route_id").where((F.col("along") >= F.col("low") - 400) & (F.col("along") <= F.col("high") + 400))
    turn = geo.angle_between(geo.bearing(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")), F.col("heading"))
    nearest = both.groupBy("event_id", "direction").agg(F.min(F.struct(F.round("offset", 3).alias("off"), "seg", turn.alias("turn"))).alias("b"))
    best = nearest.groupBy("event_id").agg(F.min(F.struct((F.col("b.turn") + F.col("b.off") / 10).alias("score"), "direction", F.col("b.turn").alias("turn"))).alias("b"))
    return best.select("event_id", F.when(F.col("b.turn") <= 70, F.col("b.direction")).alias("direction"))
