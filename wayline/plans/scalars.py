"""Queries on clocks, labels, compass readings and running folds."""

from __future__ import annotations

from math import exp, fmod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions import clock, geo, sensors
from wayline.operators.carried import scan
from wayline.plans.base import query
from wayline.sources.tables import stop_legs, table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def modulo(by: int, n: int) -> Column:
    return F.col("event_id") * by % n


@query("t01_local_minutes", "select event_id, cast(extract(hour from ts + interval 4 hour)*60 + extract(minute from ts) as bigint) as minute from events")
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", clock.local_minutes(F.col("ts").cast("timestamp")).alias("minute"))


@query("t02_clock_to_minutes", "select o_orderkey, cast(o_orderkey % 24 * 60 + o_orderkey*7 % 60 as bigint) as minute from orders")
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.concat(F.lpad((key % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((key * 7 % 60).cast("string"), 2, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", clock.to_minutes(text).alias("minute"))


@query("t03_minutes_to_clock", "select o_orderkey, lpad(cast(m // 60 as varchar), 2, '0') || ':' || lpad(cast(m % 60 as varchar), 2, '0') as clock from (select o_orderkey, ((cast(floor(o_orderkey*1.7e0 - 900 + 0.5e0) as bigint) % 1440) + 1440) % 1440 as m from orders)")
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", clock.to_clock(F.col("o_orderkey") * F.lit(1.7) - 900).alias("clock"))


@query("t05_scheduled_at", "select event_id, epoch_us(ts + (event_id % 90) * interval 1 minute) // 1000 as at_ms from events")
def t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp") + F.make_dt_interval(mins=(F.col("event_id") % 90).cast("int"))
    return events(spark, sf_dir).select("event_id", F.unix_millis(at).alias("at_ms"))


@query("t06_duration", "select event_id, case when m < 60 then m || ' min' when m % 60 = 0 then m // 60 || ' h' else m // 60 || ' h ' || m % 60 || ' min' end as label from (select event_id, cast(greatest(1, ceil(value*1.5e0 - 1e-9)) as bigint) as m from events)")
def t06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", clock.duration(F.col("value") * 1.5).alias("label"))


@query("t07_distance_label", "select event_id, case when v < 1000 then cast(greatest(10, floor(v/10 + 0.5e0)*10) as bigint) || ' m' else cast(floor(v/100 + 0.5e0) as bigint) // 10 || '.' || cast(floor(v/100 + 0.5e0) as bigint) % 10 || ' km' end as label from (select event_id, value*31.7e0 as v from events)")
def t07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", clock.distance_label(F.col("value") * 31.7).alias("label"))


@query("t08_plural", "select event_id, case when event_id % 10 = 1 and event_id % 100 <> 11 then 'one' when event_id % 10 between 2 and 4 and event_id % 100 not between 12 and 14 then 'few' else 'many' end as form from events")
def t08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", clock.slavic_plural(F.col("event_id")).alias("form"))


@query("t09_locale_choice", "select event_id, coalesce(list_filter([['de','en'],['ka'],['fr','es'],['en-GB','ka'],[]][event_id % 5 + 1], lambda x: x[1:2] in ('ka','en','ru'))[1][1:2], 'ru') as locale from events")
def t09(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in (["de", "en"], ["ka"], ["fr", "es"], ["en-GB", "ka"], [])))
    preferred = F.element_at(wanted, (F.col("event_id") % 5 + 1).cast("int"))
    known = F.filter(preferred, lambda x: F.substring(x, 1, 2).isin("ka", "en", "ru"))
    return events(spark, sf_dir).select("event_id", F.coalesce(F.substring(F.get(known, F.lit(0)), 1, 2), F.lit("ru")).alias("locale"))


@query("t10_walking", "select event_id, round(value*1.25e0, 6) as metres, round(value*1.25e0/75, 6) as minutes from events")
def t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    metres = F.col("value") * 1.25
    return events(spark, sf_dir).select("event_id", F.round(metres, 6).alias("metres"), F.round(metres / 75, 6).alias("minutes"))


@query("t11_clock_now", "select event_id, strftime(ts + interval 4 hour, '%H:%M') as clock from events")
def t11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), clock.ZONE), "HH:mm").alias("clock"))


@query("t12_ordinal", "select event_id, event_id || case when event_id % 100 between 11 and 13 then 'th' when event_id % 10 = 1 then 'st' when event_id % 10 = 2 then 'nd' when event_id % 10 = 3 then 'rd' else 'th' end as label from events")
def t12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", clock.ordinal(F.col("event_id")).alias("label"))


@query("p02_locale_pick", "select p_partkey, coalesce(nullif(case when p_partkey % 3 = 0 then '' else p_name end, ''), nullif(p_brand, ''), p_type, '') as name from part")
def p02(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.nullif(first, F.lit("")), F.nullif("p_brand", F.lit("")), "p_type", F.lit("")).alias("name"))


@query("p03_hue", "select p_brand, cast(floor(((25 + (row_number() over (order by p_brand) - 1)*137.508e0) % 360) + 0.5e0) as bigint) % 360 as hue from (select distinct p_brand from part)")
def p03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden angle over the rank of a line; lines are few, and ranked in one small window."""
    rank = F.row_number().over(Window.orderBy("p_brand")) - 1
    return table(spark, sf_dir, "part").select("p_brand").distinct().select("p_brand", (geo.nearest_whole((25 + rank * F.lit(137.508)) % 360) % 360).alias("hue"))


@query("p04_static_direction", "select p_partkey, case when p_size % 4 = 2 then 2 else 1 end as direction from part")
def p04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 4 == 2, 2).otherwise(1).alias("direction"))


@query("p05_vehicle_id", "select event_id, coalesce(nullif(trim(case when event_id % 4 = 0 then '  ' else ' B-' || user_id end), ''), user_id % 25 || ':' || event_id) as id from events")
def p05(spark: SparkSession, sf_dir: str) -> DataFrame:
    plate = F.when(F.col("event_id") % 4 == 0, "  ").otherwise(F.concat(F.lit(" B-"), "user_id"))
    return events(spark, sf_dir).select("event_id", F.coalesce(F.nullif(F.trim(plate), F.lit("")), F.concat_ws(":", F.col("user_id") % 25, "event_id")).alias("id"))


@query("p06_direction_ladder", "select event_id, coalesce(case when event_id % 5 in (1, 2) then event_id % 5 end, case when event_id % 3 > 0 then event_id % 3 end, last_value(case when event_id % 5 in (1, 2) then event_id % 5 when event_id % 3 > 0 then event_id % 3 end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding)) as direction from events")
def p06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported, else inferred, else the vehicle's last known."""
    e = F.col("event_id")
    own = F.coalesce(F.when((e % 5).isin(1, 2), e % 5), F.when(e % 3 > 0, e % 3))
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return events(spark, sf_dir).select("event_id", F.coalesce(own, F.last(own, ignorenulls=True).over(before)).alias("direction"))


@query("p09_clamped_speed", "select event_id, least(45, greatest(10, coalesce(case when event_id % 6 > 0 then value end, 18))) as kmh from events")
def p09(spark: SparkSession, sf_dir: str) -> DataFrame:
    speed = F.when(F.col("event_id") % 6 > 0, F.col("value"))
    return events(spark, sf_dir).select("event_id", F.least(F.lit(45.0), F.greatest(F.lit(10.0), F.coalesce(speed, F.lit(18.0)))).alias("kmh"))


@query("p10_confidence", "select event_id, case when event_id % 300 > 150 or event_id % 6 = 0 or floor(value + 0.5e0) < 10 then 'slow' else 'live' end as confidence from events")
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    slow = (F.col("event_id") % 300 > 150) | (F.col("event_id") % 6 == 0) | (geo.nearest_whole(F.col("value")) < 10)
    return events(spark, sf_dir).select("event_id", F.when(slow, "slow").otherwise("live").alias("confidence"))


@query("p12_scheduled_label", "select event_id, case when event_id % 500 > 240 then 'tomorrow' else event_id % 500 || ' min' end as label from events")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 500
    return events(spark, sf_dir).select("event_id", F.when(m > 240, "tomorrow").otherwise(F.concat(m.cast("string"), F.lit(" min"))).alias("label"))


@query("p15_kind", "select p_partkey, case when p_name like '%gear%' then 'shop' when p_name like '%bolt%' then 'food' when p_size > 40 then 'hotel' when p_type = 'SMALL' then 'sight' else 'other' end as kind from part")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    kind = F.when(name.contains("gear"), "shop").when(name.contains("bolt"), "food").when(F.col("p_size") > 40, "hotel").when(F.col("p_type") == "SMALL", "sight").otherwise("other")
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))


@query("p16_first_tag", "select event_id, coalesce(nullif(nullif(tag, 'error'), 'view'), nullif(k, '5'), 'none') as tag from (select event_id, event_type as tag, json_extract_string(props, '$.k') as k from events)")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tag that says anything; one of them inside a JSON column."""
    tags = F.map_from_arrays(F.array(F.lit("type"), F.lit("k")), F.array("event_type", F.get_json_object("props", "$.k")))
    first = F.nullif(F.nullif(F.element_at(tags, "type"), F.lit("error")), F.lit("view"))
    return events(spark, sf_dir).select("event_id", F.coalesce(first, F.nullif(F.element_at(tags, "k"), F.lit("5")), F.lit("none")).alias("tag"))


@query("t50_normalise", "select event_id, ((event_id*37 - 5000) % 360 + 360) % 360 as degrees from events")
def t50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", sensors.normalise(F.col("event_id") * 37 - 5000).alias("degrees"))


TURN = "(select event_id, ((event_id*53 - event_id*37) % 360 + 360) % 360 as d, event_id*37 % 360 as a from events)"


@query("t51_shortest_turn", f"select event_id, cast(case when d > 180 then d - 360 else d end as double) as turn from {TURN}")
def t51(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", geo.shortest_turn((F.col("event_id") * 37).cast("double"), (F.col("event_id") * 53).cast("double")).alias("turn"))


@query("t52_ease_bearing", f"select event_id, ((a + (case when d > 180 then d - 360 else d end)*0.25e0) % 360 + 360) % 360 as degrees from {TURN}")
def t52(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = modulo(37, 360).cast("double"), (F.col("event_id") * 53).cast("double")
    return events(spark, sf_dir).select("event_id", sensors.ease_bearing(a, b, F.lit(0.25)).alias("degrees"))


@query("t53_facing", """with a as (select event_id, radians(event_id*17 % 360) as a, radians(event_id*29 % 180 - 90) as b, radians(event_id*41 % 180 - 90) as g, radians((event_id % 4)*90) as s from events),
v as (select event_id, cos(a)*cos(g) - sin(a)*sin(b)*sin(g) as e0, -sin(a)*cos(b) as e1, cos(a)*sin(g) + sin(a)*sin(b)*cos(g) as e2, sin(a)*cos(g) + cos(a)*sin(b)*sin(g) as n0, cos(a)*cos(b) as n1, sin(a)*sin(g) - cos(a)*sin(b)*cos(g) as n2, s from a),
t as (select event_id, e0*sin(s) + e1*cos(s) as te, n0*sin(s) + n1*cos(s) as tn, -e2 as be, -n2 as bn from v),
f as (select event_id, te*sqrt(te*te+tn*tn) + be*sqrt(be*be+bn*bn) as e, tn*sqrt(te*te+tn*tn) + bn*sqrt(be*be+bn*bn) as n from t)
select event_id, case when round(sqrt(e*e+n*n), 6) >= 0.2 then (round(degrees(atan2(e, n)), 3) + 360) % 360 end as degrees from f""")
def t53(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sensors.facing(modulo(17, 360), modulo(29, 180) - 90, modulo(41, 180) - 90, F.col("event_id") % 4 * 90)
    return events(spark, sf_dir).select("event_id", found.alias("degrees"))


@query("t54_read_heading", "select event_id, case when event_id % 3 = 0 then case when event_id % 2 = 0 then ((event_id + 90) % 360 + 360) % 360 end when event_id % 3 = 1 then ((720 - event_id % 360 + 90) % 360 + 360) % 360 end as degrees from events")
def t54(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compass reading if it is accurate, else an absolute flat pose, else nothing."""
    e = F.col("event_id")
    compass, accuracy, absolute = F.when(e % 3 == 0, e), F.when(e % 2 == 0, 5).otherwise(-1), e % 3 == 1
    return events(spark, sf_dir).select("event_id", sensors.read_heading(compass, accuracy, absolute, e % 360, F.lit(90)).alias("degrees"))


@query("w14_running_turn", "with d as (select event_id, user_id, ((event_id*37 % 360) - lag(event_id*37 % 360) over w + 720) % 360 as d from events window w as (partition by user_id order by event_id)) select event_id, cast(sum(case when d is null then 0 when d >= 180 then d - 360 else d end) over (partition by user_id order by event_id rows unbounded preceding) as bigint) as turned from d")
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    at = modulo(37, 360)
    d = F.pmod(at - F.lag(at).over(w), F.lit(360))
    turn = F.coalesce(F.when(d >= 180, d - 360).otherwise(d), F.lit(0))
    rows = events(spark, sf_dir).withColumn("turn", turn)
    return rows.select("event_id", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("turned"))


def whole_turn(degrees: float) -> float:
    """Degrees from 0 to less than 360; Python's own remainder makes 360 of the least below 0."""
    return fmod(fmod(degrees, 360) + 360, 360)


def eased(shown: float, read: float, seconds: float) -> float:
    """The shown bearing after some seconds on the way to the one that was read, by the shorter turn."""
    turn = whole_turn(read - shown)
    return round(whole_turn(shown + (turn - 360 if turn > 180 else turn) * (1 - exp(-seconds / 120))), 6)


@query("w15_bearing_average", """with recursive x as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n, cast(event_id*37 % 360 as double) as a from events),
run as (select user_id, n, event_id, a as shown from x where n = 1
 union all select x.user_id, x.n, x.event_id, round((((run.shown + (case when ((x.a - run.shown) % 360 + 360) % 360 > 180 then ((x.a - run.shown) % 360 + 360) % 360 - 360 else ((x.a - run.shown) % 360 + 360) % 360 end) * (1 - exp(-(x.event_id - run.event_id)/120e0))) % 360) + 360) % 360, 6) from run join x on x.user_id = run.user_id and x.n = run.n + 1)
select event_id, shown as degrees from run""")
def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bearing eased toward each reading by the time since the last."""

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        at, a = row
        if state is None:
            return (at, a), (a,)
        shown = eased(state[1], a, at - state[0])
        return (at, shown), (shown,)

    rows = events(spark, sf_dir).select("user_id", "event_id", modulo(37, 360).cast("double").alias("a"))
    return scan(rows, "user_id", ["event_id"], ["a"], step, "at bigint, shown double", "degrees double").select("event_id", "degrees")


@query("w16_anchor", """with recursive x as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n, event_id*131 % 400 as a from events),
run as (select user_id, n, event_id, a as anchor from x where n = 1 union all select x.user_id, x.n, x.event_id, case when abs(x.a - run.anchor) > 50 then x.a else run.anchor end from run join x on x.user_id = run.user_id and x.n = run.n + 1)
select event_id, cast(anchor as bigint) as anchor from run""")
def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place that follows only moves of more than 50 m."""

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        after = state if state and abs(row[1] - state[0]) <= 50 else (row[1],)
        return after, after

    rows = events(spark, sf_dir).select("user_id", "event_id", modulo(131, 400).cast("bigint").alias("a"))
    return scan(rows, "user_id", ["event_id"], ["a"], step, "anchor bigint", "anchor bigint").select("event_id", "anchor")


@query("w17_failure_runs", "with g as (select event_id, user_id, event_type, count(*) filter (where event_type <> 'error') over (partition by user_id order by event_id rows unbounded preceding) as g from events) select event_id, cast(case when event_type = 'error' then row_number() over (partition by user_id, g, event_type = 'error' order by event_id) else 0 end as bigint) as run, event_type = 'error' and row_number() over (partition by user_id, g, event_type = 'error' order by event_id) >= 3 as stale from g")
def w17(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = events(spark, sf_dir).withColumn("island", F.count_if(~failed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.when(failed, F.count_if(failed).over(Window.partitionBy("user_id", "island").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))).otherwise(0)
    return rows.select("event_id", run.alias("run"), (run >= 3).alias("stale"))


@query("g02_planner_distance", "select stop_id, round(2*6371000e0*asin(sqrt(pow(sin(radians(41.6e0-lat)/2),2)+cos(radians(lat))*cos(radians(41.6e0))*pow(sin(radians(41.6e0-lon)/2),2))), 3) as metres from stop_leg")
def g02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_legs(spark, sf_dir).select("stop_id", F.round(geo.haversine(F.col("lat"), F.col("lon"), F.lit(41.6), F.lit(41.6)), 3).alias("metres"))
