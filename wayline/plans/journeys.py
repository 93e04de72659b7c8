"""Queries on journeys: the planner's network, its searches and its ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators import planner
from wayline.operators.stages import cut
from wayline.plans.base import haversine, query
from wayline.sources.tables import stop_legs, table

PATTERNS = f"""hopped as (select *, count(*) over (partition by route_id, direction) as n, coalesce({haversine("lag(lat) over w", "lag(lon) over w", "lat", "lon")}, 0e0)*1.08e0 as hop from stop_leg window w as (partition by route_id, direction order by seq)),
plain as (select *, sum(hop) over (partition by route_id, direction order by seq rows unbounded preceding) as metres from hopped where n > 1),
turn as (select a.route_id, a.direction as before, b.direction as after, a.n - 1 as turn, a.metres + 1.08e0*{haversine("a.lat", "a.lon", "b.lat", "b.lon")} as beyond from plain a join plain b on a.route_id = b.route_id and a.direction <> b.direction and a.seq = a.n - 1 and b.seq = 0 where {haversine("a.lat", "a.lon", "b.lat", "b.lon")} <= 600),
ps as (select route_id || ':' || direction as pattern, route_id, direction, seq as pos, stop_id, metres/(19.6e0*1000/60) as minutes, cast(null as bigint) as turns_at from plain
 union all select p.route_id || ':' || p.direction || '+', p.route_id, p.direction, seq, stop_id, metres/(19.6e0*1000/60), turn from plain p join turn t on p.route_id = t.route_id and p.direction = t.before
 union all select p.route_id || ':' || t.before || '+', p.route_id, t.before, seq + turn + 1, stop_id, (metres + beyond)/(19.6e0*1000/60), turn from plain p join turn t on p.route_id = t.route_id and p.direction = t.after)"""

#: A trip of each supplier, or of each nation, from a start to an end in the grid of lines.
ASKING = {"supplier": "s_suppkey", "nation": "n_nationkey"}


def trip_sql(who: str) -> str:
    return f"""trip as (
  select k as query_id, 41.5e0 + (k*7 % 25)*0.003e0 + 0.0004e0 as from_lat, 41.5e0 + (k*11 % last)*0.003e0 + 0.0007e0 as from_lon,
    41.5e0 + ((k*7 + k % 4*2) % 25)*0.003e0 - 0.0003e0 as to_lat, 41.5e0 + (k*17 % last)*0.003e0 - 0.0002e0 as to_lon
  from (select cast({ASKING[who]} as bigint) as k from {who}) w, (select max(seq) + 1 as last from stop_leg) l)"""


TRIPS = trip_sql("supplier")


def ends(end: str) -> str:
    far = haversine(f"{end}_lat", f"{end}_lon", "lat", "lon")
    return f"(select query_id, stop_id, {far}*1.25e0/75 as walk from trip join stop_leg on abs(lat - {end}_lat) < 0.02 where {far} <= 1200)"


BOTH = f"acc as {ends('from')}, egr as {ends('to')}"


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_legs(spark, sf_dir).select("route_id", "direction", "seq", "stop_id", "lat", "lon")


def trips(spark: SparkSession, sf_dir: str, who: str = "supplier") -> DataFrame:
    """What people ask: query_id, from_lat, from_lon, to_lat, to_lon."""
    last = F.broadcast(stop_legs(spark, sf_dir).agg((F.max("seq") + 1).alias("last")))  # one row
    k = F.col("query_id")
    own = table(spark, sf_dir, who).select(F.col(ASKING[who]).cast("bigint").alias("query_id")).crossJoin(last)
    at = lambda x, off: F.lit(41.5) + x * F.lit(0.003) + F.lit(off)
    return own.select(
        "query_id", at(k * 7 % 25, 0.0004).alias("from_lat"), at(k * 11 % F.col("last"), 0.0007).alias("from_lon"),
        at((k * 7 + k % 4 * 2) % 25, -0.0003).alias("to_lat"), at(k * 17 % F.col("last"), -0.0002).alias("to_lon"),
    )


def prepared(spark: SparkSession, sf_dir: str, who: str = "supplier") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Access, egress, pattern stops and changes for the trips."""
    own, asked = legs(spark, sf_dir), trips(spark, sf_dir, who)
    stops = own.select("stop_id", "lat", "lon")
    paths = planner.changes(planner.build_footpaths(stops), stops)
    return cut(planner.access(asked, stops, "from")), cut(planner.access(asked, stops, "to")), cut(planner.build_patterns(own)), cut(paths)


@query("c05_patterns", f"with {PATTERNS} select pattern, cast(pos as bigint) as pos, stop_id, round(minutes, 6) as minutes, turns_at from ps")
def c05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each direction's stops, and those of the bus that drives on as the other direction."""
    rows = planner.build_patterns(legs(spark, sf_dir))
    return rows.select("pattern", F.col("pos").cast("bigint").alias("pos"), "stop_id", F.round("minutes", 6).alias("minutes"), "turns_at")


@query("c04_board_and_alight", f"with {PATTERNS} select pattern, count(*) filter (where turns_at is null or pos <= turns_at) as board, count(*) filter (where turns_at is null or pos > turns_at) as alight from ps group by pattern")
def c04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planner.build_patterns(legs(spark, sf_dir))
    return rows.groupBy("pattern").agg(F.count_if(planner.can_board()).alias("board"), F.count_if(planner.can_alight()).alias("alight"))


@query("j11_direct", f"""with {PATTERNS}, {TRIPS}, {BOTH}
select a.query_id, b.pattern, round(min(1.5e0*a.walk - b.minutes + e.minutes + 1.5e0*g.walk), 4) as felt from acc a join ps b on b.stop_id = a.stop_id and (b.turns_at is null or b.pos <= b.turns_at)
join ps e on e.pattern = b.pattern and e.pos > b.pos and (e.turns_at is null or e.pos > e.turns_at) join egr g on g.query_id = a.query_id and g.stop_id = e.stop_id group by a.query_id, b.pattern""")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    walk_in, egress, rows, _ = prepared(spark, sf_dir)
    found = planner.direct(walk_in, egress, rows)
    return found.select("query_id", F.col("rides")[0]["pattern"].alias("pattern"), F.round("cost", 4).alias("felt"))


ONE_CHANGE = f"""with {PATTERNS}, {TRIPS}, {BOTH},
first as (select a.query_id, b.pattern, e.route_id, e.stop_id, e.pos, min(1.5e0*a.walk - b.minutes) + min(e.minutes) as cost from acc a join ps b on b.stop_id = a.stop_id and (b.turns_at is null or b.pos <= b.turns_at)
 join ps e on e.pattern = b.pattern and e.pos > b.pos and (e.turns_at is null or e.pos > e.turns_at) group by a.query_id, b.pattern, e.route_id, e.stop_id, e.pos),
second as (select g.query_id, b.pattern, b.route_id, b.stop_id, b.pos, min(e.minutes + 1.5e0*g.walk) - min(b.minutes) as cost from egr g join ps e on e.stop_id = g.stop_id and (e.turns_at is null or e.pos > e.turns_at)
 join ps b on b.pattern = e.pattern and e.pos > b.pos and (b.turns_at is null or b.pos <= b.turns_at) group by g.query_id, b.pattern, b.route_id, b.stop_id, b.pos),
path as (select stop_id, stop_id as to_stop, 0e0 as walk from stop_leg union all
 select s.stop_id, r.stop_id, {haversine("s.lat", "s.lon", "r.lat", "r.lon")}*1.25e0/75 from stop_leg s join stop_leg r on abs(s.lat - r.lat) < 0.005 and abs(s.lon - r.lon) < 0.006 and s.stop_id <> r.stop_id where {haversine("s.lat", "s.lon", "r.lat", "r.lon")} <= 400)
select f.query_id, f.pattern as one, s.pattern as two, round(min(f.cost + 1.5e0*p.walk + s.cost), 4) as felt from first f join path p on p.stop_id = f.stop_id join second s on s.query_id = f.query_id and s.stop_id = p.to_stop and s.route_id <> f.route_id group by f.query_id, f.pattern, s.pattern"""


@query("j12_one_change", ONE_CHANGE)
def j12(spark: SparkSession, sf_dir: str, who: str = "supplier") -> DataFrame:
    walk_in, egress, rows, paths = prepared(spark, sf_dir, who)
    found = planner.one_change(walk_in, egress, rows, paths)
    return found.select("query_id", F.col("rides")[0]["pattern"].alias("one"), F.col("rides")[1]["pattern"].alias("two"), F.round("cost", 4).alias("felt"))


@query("j12_one_change_nations", ONE_CHANGE.replace(TRIPS, trip_sql("nation")))
def j12_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j12(spark, sf_dir, "nation")


@query("j13_two_changes")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best journey with three rides of each trip."""
    walk_in, egress, rows, paths = prepared(spark, sf_dir)
    found = planner.two_changes(walk_in, egress, rows, paths, trips(spark, sf_dir))
    return found.select("query_id", F.transform("rides", lambda r: r["pattern"]).alias("patterns"), F.round("cost", 4).alias("felt"))


def rounds_sql() -> str:
    """Least felt minutes of three rides in a row, stop by stop."""
    on = "ps b on b.stop_id = l.stop_id and (b.turns_at is null or b.pos <= b.turns_at) join ps e on e.pattern = b.pattern and e.pos > b.pos and (e.turns_at is null or e.pos > e.turns_at)"
    rounds = "\n".join(
        f"""off{k} as (select l.query_id, e.stop_id, min(l.cost - b.minutes + e.minutes) as cost from on{k} l join {on} group by l.query_id, e.stop_id),
on{k + 1} as (select query_id, to_stop as stop_id, min(cost + 1.5e0*p.walk + 5) as cost from off{k} join path p using (stop_id) group by query_id, to_stop),"""
        for k in range(3)
    )
    path = ONE_CHANGE[ONE_CHANGE.index("path as (") : ONE_CHANGE.index("\nselect f.query_id")]
    return f"""with {PATTERNS}, {TRIPS}, {BOTH}, {path}, on0 as (select query_id, stop_id, 1.5e0*walk as cost from acc),
{rounds.rstrip(",")}
select query_id, round(min(cost + 1.5e0*g.walk), 4) as felt from off2 join egr g using (query_id, stop_id) group by query_id"""


@query("j13_least_of_two_changes", rounds_sql())
def j13_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the best journey with three rides of each trip feels like, in minutes."""
    walk_in, egress, rows, paths = prepared(spark, sf_dir)
    return planner.two_changes(walk_in, egress, rows, paths, trips(spark, sf_dir)).select("query_id", F.round("cost", 4).alias("felt"))


def planned(spark: SparkSession, sf_dir: str, who: str = "supplier") -> DataFrame:
    return planner.plan(trips(spark, sf_dir, who), legs(spark, sf_dir))


@query("c06_plan")
def c06(spark: SparkSession, sf_dir: str, who: str = "supplier") -> DataFrame:
    """The options that a traveller is shown."""
    rows = planned(spark, sf_dir, who)
    return rows.select("query_id", "place", "key", F.round("minutes", 3).alias("minutes"), "n_rides", F.round("walk_minutes", 3).alias("walk_minutes"), F.round("cost", 3).alias("cost"), F.array_join(F.transform("also", lambda x: F.array_join(x, ",")), "|").alias("also"))


@query("c06_plan_nations")
def c06_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c06(spark, sf_dir, "nation")


@query("p19_leg_strip")
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The legs of each option in order; walks under a minute are hidden."""
    rows = planner.steps(planned(spark, sf_dir)).where("kind = 'ride' or minutes >= 1")
    return rows.select("query_id", "place", "step", "kind", "from_stop", "to_stop", F.round("minutes", 3).alias("minutes"))


@query("p14_journey_geometry")
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stops that each ride of an option goes by, as its line on the map."""
    rides = planned(spark, sf_dir).select("query_id", "place", F.posexplode("rides").alias("leg", "r")).select("query_id", "place", "leg", "r.pattern", "r.board", "r.alight")
    on = planner.build_patterns(legs(spark, sf_dir)).join(rides, "pattern").where("pos between board and alight")
    line = F.transform(F.sort_array(F.collect_list(F.struct("pos", "lat", "lon"))), lambda x: F.concat_ws(",", F.round(x["lat"], 5), F.round(x["lon"], 5)))
    return on.groupBy("query_id", "place", "leg").agg(F.array_join(line, ";").alias("line"))


@query("c01_walk_only", f"with {TRIPS} select query_id, round({haversine('from_lat', 'from_lon', 'to_lat', 'to_lon')}*1.25e0/75, 4) as minutes, {haversine('from_lat', 'from_lon', 'to_lat', 'to_lon')} <= 250 as just_walk from trip")
def c01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planner.on_foot(trips(spark, sf_dir))
    return rows.select("query_id", F.round(F.col("walks")[0]["minutes"], 4).alias("minutes"), (F.col("straight") <= planner.JUST_WALK).alias("just_walk"))


@query("c02_ends_without_stops", f"with t as (select c_custkey as query_id, 41.5e0 + c_custkey % 3 as lat, 41.5e0 + c_custkey % 2 as lon from customer) select query_id, case when lat > 42 then 'from' when lon > 42 then 'to' end as none_near from t")
def c02(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(k.alias("query_id"), (F.lit(41.5) + k % 3).alias("from_lat"), F.lit(41.5).alias("from_lon"), F.lit(41.5).alias("to_lat"), (F.lit(41.5) + k % 2).alias("to_lon"))
    return planner.ends_without_stops(asked, legs(spark, sf_dir).select("stop_id", "lat", "lon"))


OPTIONS = "option as (select o_custkey as query_id, o_orderkey, o_totalprice/3000 as minutes, cast(o_orderkey % 3 as int) as n_rides, (o_orderkey*7 % 40)/2e0 as walk_minutes from orders)"


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up journeys: orders stand for options of their customer."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), "o_orderkey", (F.col("o_totalprice") / 3000).alias("minutes"), (k % 3).cast("int").alias("n_rides"), (k * 7 % 40 / F.lit(2.0)).alias("walk_minutes"))


@query("j23_undominated", f"with {OPTIONS} select query_id, o_orderkey from option a where not exists (select 1 from option b where b.query_id = a.query_id and b.minutes <= a.minutes and b.n_rides <= a.n_rides and b.walk_minutes <= a.walk_minutes and (b.minutes < a.minutes - 2 or b.n_rides < a.n_rides or b.walk_minutes < a.walk_minutes - 2))")
def j23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.undominated(options(spark, sf_dir)).select("query_id", "o_orderkey")


LINES = """line as (select l_orderkey as query_id, l_suppkey as route_id, 1 + l_linenumber % 2 as direction, l_partkey as from_stop, l_partkey + 1 as to_stop, l_quantity as minutes, l_linenumber % 4/2e0 as walk,
  row_number() over w as i from lineitem where l_returnflag = 'N' window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)),
journey as (select l_orderkey as query_id from lineitem group by l_orderkey)"""


def made_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a journey: each line that was not returned is a ride after a short walk, or none; at the end one more walk."""
    line = table(spark, sf_dir, "lineitem")
    ride = F.struct(F.col("l_suppkey").alias("route_id"), (1 + F.col("l_linenumber") % 2).alias("direction"), F.col("l_partkey").alias("from_stop"), (F.col("l_partkey") + 1).alias("to_stop"), F.col("l_quantity").alias("minutes"), (F.col("l_quantity") * 300).alias("metres"))
    foot = lambda minutes: F.struct(minutes.alias("minutes"), (minutes * 60).alias("metres"))
    walk = foot(F.col("l_linenumber") % 4 / F.lit(2.0))
    each = F.when(F.col("l_returnflag") == "N", F.struct("l_linenumber", "l_partkey", "l_suppkey", ride.alias("ride"), walk.alias("walk")))
    rows = line.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.sort_array(F.collect_list(each)).alias("x"))  # seven lines at most
    return rows.select("query_id", F.lit(1).alias("place"), F.transform("x", lambda x: x["ride"]).alias("rides"), F.concat(F.transform("x", lambda x: x["walk"]), F.array(foot(F.lit(1.5)))).alias("walks"))


@query("c07_priced_journeys", f"""with {LINES}, total as (select query_id, count(*) as n, sum(minutes) as ride, sum(walk) as walk, string_agg(route_id || ':' || direction, '>' order by i) as key from line group by query_id),
t as (select query_id, coalesce(n, 0) as n, coalesce(ride, 0e0) as ride, coalesce(walk, 0e0) + 1.5e0 as walk, coalesce(key, 'walk') as key from journey left join total using (query_id))
select query_id, round(ride + walk, 6) as minutes, round(walk, 6) as walk_minutes, cast(n as int) as n_rides, round(ride + walk + 0.5e0*walk + 5*n + 5*greatest(n - 1, 0), 6) as cost, key from t""")
def c07_priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What journeys take and cost, and the key of their lines."""
    rows = planner.price(made_up(spark, sf_dir))
    return rows.select("query_id", *(F.round(c, 6).alias(c) for c in ("minutes", "walk_minutes")), "n_rides", F.round("cost", 6).alias("cost"), "key")


@query("p13_journey_steps", f"""with {LINES}, last as (select query_id, arg_max(to_stop, i) as stop from line group by query_id),
leg as (
  select query_id, i, 0 as k, 'walk' as kind, lag(to_stop) over (partition by query_id order by i) as from_stop, from_stop as to_stop, walk as minutes, walk*60 as metres from line
  union all select query_id, i, 1, 'ride', from_stop, to_stop, minutes, minutes*300 from line
  union all select query_id, 1000000, 0, 'walk', stop, null, 1.5e0, 90e0 from journey left join last using (query_id))
select query_id, row_number() over (partition by query_id order by i, k) - 1 as step, kind, from_stop, to_stop, round(minutes, 6) as minutes, round(metres, 6) as metres from leg where kind = 'ride' or metres > 1""")
def p13_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The legs of journeys in order; walks of up to a metre are left out."""
    rows = planner.steps(made_up(spark, sf_dir))
    return rows.select("query_id", F.col("step").cast("bigint").alias("step"), "kind", "from_stop", "to_stop", F.round("minutes", 6).alias("minutes"), F.round("metres", 6).alias("metres"))


@query("w10_rank", f"""with {OPTIONS}, c as (select *, minutes + 0.5e0*walk_minutes + 5*n_rides as cost, cast(o_orderkey % 7 as varchar) as key from option),
once as (select * from (select *, row_number() over (partition by query_id, key order by round(cost, 6), round(minutes, 6), o_orderkey) as r from c) where r = 1),
kept as (select *, min(cost) over (partition by query_id) as least, row_number() over (partition by query_id, n_rides > 0 order by round(cost, 6), round(minutes, 6), key) as bus from once)
select query_id, place, o_orderkey from (select *, row_number() over (partition by query_id order by round(cost, 6), round(minutes, 6), key) as place from kept where cost <= least*1.5e0 + 10 or (n_rides > 0 and bus = 1)) where place <= 5""")
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = options(spark, sf_dir).withColumns({"cost": F.col("minutes") + 0.5 * F.col("walk_minutes") + 5 * F.col("n_rides"), "key": (F.col("o_orderkey") % 7).cast("string"), "rides": F.col("o_orderkey")})
    return planner.rank(rows).select("query_id", "place", "o_orderkey")


@query("a17_merged", """with t as (select o_custkey as query_id, o_orderkey as id, o_orderkey % 5 as line, o_orderkey % 3 as pole, o_totalprice/20000 as minutes from orders),
g as (select *, first(line) over w as best_line, minutes - first(minutes) over w <= 2 as alike, row_number() over w as n from t window w as (partition by query_id, pole order by round(minutes + 5, 6), line || ':1', id))
select query_id, id, array_to_string(case when n = 1 then coalesce((select list_sort(list_distinct(list(h.line || ':1'))) from g h where h.query_id = g.query_id and h.pole = g.pole and h.alike and h.n > 1 and h.line <> g.line), []) else [] end, ',') as also from g where n = 1 or not alike""")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that make the same ride in about the same time are one option."""
    k = F.col("o_orderkey")
    ride = F.struct((k % 5).alias("route_id"), F.lit(1).alias("direction"), (k % 3).alias("from_stop"), (k % 3).alias("to_stop"), k.alias("id"))
    foot = F.struct(F.lit(0.0).alias("minutes"), F.lit(0.0).alias("metres"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), k.alias("id"), (F.col("o_totalprice") / 20000).alias("minutes"), F.array(ride).alias("rides"), F.array(foot, foot).alias("walks"))
    rows = rows.withColumns({"n_rides": F.lit(1), "cost": F.col("minutes") + 5, "key": F.concat((F.col("id") % 5).cast("string"), F.lit(":1"))})
    return planner.merge(rows).select("query_id", "id", F.array_join(F.array_sort(F.flatten("also")), ",").alias("also"))
