"""Queries on filters, joins, aggregates, order and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions import geo
from wayline.operators import linear, resolve, search
from wayline.operators.distance import first_by
from wayline.plans.base import SEGMENTS, query
from wayline.sources import feed
from wayline.sources.tables import pings, running_times, shape_points, stop_legs, table

BOX = (41.51, 41.505, 41.55, 41.56)  #: south, west, north, east


@query("s01_nested_feed", "select stop_id, route_id, direction, seq as ord from stop_leg where route_id < 20")
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network as one nested document, parsed and taken apart again; lines the feed does not name are dropped."""
    stops = stop_legs(spark, sf_dir)
    entry = F.struct(F.col("direction").alias("Status"), F.col("seq").alias("Order"), F.array(F.lit("08:00")).alias("times"))
    each = stops.groupBy("stop_id", "lat", "lon").agg(F.map_from_entries(F.collect_list(F.struct(F.col("route_id").cast("string"), entry))).alias("routes"))
    document = F.struct(F.col("stop_id").cast("string").alias("id"), "lat", "lon", "routes")
    names = F.map_from_entries(F.array(*(F.struct(F.lit(str(r)), F.struct(F.lit(str(r)).alias("id"))) for r in range(20))))
    data = F.to_json(F.struct(F.struct(F.create_map(F.col("stop_id").cast("string"), document).alias("busStops"), names.alias("routesNames")).alias("data")))
    parsed = each.select(F.from_json(data, f"data {feed.DATASET}").alias("d")).select("d.data")
    exploded = parsed.select(F.explode("data.busStops").alias("stop_id", "s"), "data.routesNames").select("stop_id", F.explode("s.routes").alias("route_id", "x"), "routesNames")
    known = exploded.where(F.col("routesNames")[F.col("route_id")].isNotNull())
    return known.select(F.col("stop_id").cast("bigint").alias("stop_id"), F.col("route_id").cast("bigint").alias("route_id"), F.when(F.col("x.Status") == 2, 2).otherwise(1).alias("direction"), F.col("x.Order").alias("ord"))


@query("s13_packed_tuples", "select p_partkey, k, p_size + k as number, round(41.5e0 + (p_size*7 + k)/1e5, 6) as lat, round(41.6e0 + (p_size*3 - k)/1e5, 6) as lon from part, (values (0), (1), (2)) t(k) where k < p_partkey % 4")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    entries = [F.array((size + k).cast("string"), (size * 7 + k).cast("string"), (size * 3 - k).cast("string")) for k in range(3)]
    rows = F.concat(F.array(F.lit("0")), *(F.when(F.col("p_partkey") % 4 > k, e).otherwise(F.array().cast("array<string>")) for k, e in enumerate(entries)))
    each = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(feed.unpacked(rows, (41.5, 41.6))).alias("k", "x"))
    return each.select("p_partkey", F.col("k").cast("bigint").alias("k"), F.col("x.number").cast("bigint").alias("number"), F.round("x.lat", 6).alias("lat"), F.round("x.lon", 6).alias("lon"))


@query("s14_fleet", f"""{SEGMENTS}, len as (select route_id, max(cum_b) as length from seg group by route_id), bus as (select route_id, length, b, (length*b/4 + 600*20/3.6e0) - length*floor((length*b/4 + 600*20/3.6e0)/length) as at_ from len, (values (0), (1), (2), (3)) t(b))
select route_id, cast(b as bigint) as bus, case b when 0 then 1 when 1 then 2 else -1 end as status, round(a_lat + (b_lat-a_lat)*(at_-cum_a)/(cum_b-cum_a), 5) as lat, round(a_lon + (b_lon-a_lon)*(at_-cum_a)/(cum_b-cum_a), 5) as lon from bus join seg using (route_id) where at_ >= cum_a and at_ < cum_b""")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feed.fleet(linear.segments(shape_points(spark, sf_dir)), 4, 600)
    return found.select("route_id", "bus", "status", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@query("f01_box", f"select stop_id from stop_leg where lat between {BOX[0]}e0 and {BOX[2]}e0 and lon between {BOX[1]}e0 and {BOX[3]}e0")
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_legs(spark, sf_dir).where(F.col("lat").between(BOX[0], BOX[2]) & F.col("lon").between(BOX[1], BOX[3])).select("stop_id")


WANTED = " 3, 7,3 ,99,12, "


@query("f02_route_list", "select stop_id, route_id from stop_leg where route_id in (3, 7, 12)")
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list as typed by a user: trimmed, distinct, unknown lines dropped."""
    stops = stop_legs(spark, sf_dir)
    wanted = spark.range(1).select(F.explode(F.array_distinct(F.transform(F.split(F.lit(WANTED), ","), F.trim))).alias("r")).select(F.expr("try_cast(r as bigint)").alias("route_id"))
    return stops.join(F.broadcast(wanted), "route_id", "left_semi").select("stop_id", "route_id")  # as many rows as the user typed


@query("f03_finite", "select event_id from events where event_id % 4 > 1")
def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    lat = F.when(e % 4 == 0, F.lit(None).cast("double")).when(e % 4 == 1, F.when(e % 8 == 1, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").withColumn("lat", lat)
    return rows.where(F.col("lat").isNotNull() & ~F.isnan("lat") & (F.abs("lat") < float("inf"))).select("event_id")


@query("f04_in_service_counts", "select user_id, count(*) filter (where event_id*31 % 700 < 600) as n from events group by user_id")
def f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_id") * 31 % 700 < 600).alias("n"))


@query("f05_point_lookup", "select stop_id, route_id, direction, seq from stop_leg where stop_id = 117")
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_legs(spark, sf_dir).where("stop_id = 117").select("stop_id", "route_id", "direction", "seq")


@query("f06_live_routes", "select event_id from ping where route_id = 4 or (plate % 2 = 0 and route_id in (8, 9))")
def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line in focus, and the selection."""
    return pings(spark, sf_dir).where((F.col("route_id") == 4) | ((F.col("plate") % 2 == 0) & F.col("route_id").isin(8, 9))).select("event_id")


@query("f07_lists", "select p_partkey from part where p_type in ('ECONOMY', 'SMALL') and p_brand not in ('Brand#1', 'Brand#2') and regexp_matches(p_name, '[a-z]{2}')")
def f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_type").isin("ECONOMY", "SMALL") & ~F.col("p_brand").isin("Brand#1", "Brand#2") & F.col("p_name").rlike(r"\p{L}{2}")).select("p_partkey")


@query("f09_eligible", "select event_id from events where event_type <> 'error' and event_id*31 % 400 <= 300 and value <= 60 and event_id % 250 <= 200")
def f09(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").where((F.col("event_type") != "error") & (e * 31 % 400 <= 300) & (F.col("value") <= 60) & (e % 250 <= 200)).select("event_id")


@query("f10_padded_view", "select stop_id, case when route_id = 5 then 1 else 0 end as highlighted from stop_leg where lat between 41.502e0 and 41.558e0 and lon between 41.494e0 and 41.571e0 and (stop_id % 3 = 0 or route_id = 5)")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth more on each side of the view; below the zoom limit only main stops and the highlighted line."""
    pad_y, pad_x = (BOX[2] - BOX[0]) * 0.2, (BOX[3] - BOX[1]) * 0.2
    inside = F.col("lat").between(round(BOX[0] - pad_y, 6), round(BOX[2] + pad_y, 6)) & F.col("lon").between(round(BOX[1] - pad_x, 6), round(BOX[3] + pad_x, 6))
    lit = F.col("route_id") == 5
    return stop_legs(spark, sf_dir).where(inside & ((F.col("stop_id") % 3 == 0) | lit)).select("stop_id", F.when(lit, 1).otherwise(0).alias("highlighted"))


@query("f12_inset", "select stop_id from stop_leg where lat > 41.5148e0 and lat < 41.5452e0 and lon > 41.5116e0 and lon < 41.5534e0")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, x = (BOX[2] - BOX[0]) * 0.12, (BOX[3] - BOX[1]) * 0.12
    lat, lon = F.col("lat"), F.col("lon")
    return stop_legs(spark, sf_dir).where((lat > round(BOX[0] + y, 6)) & (lat < round(BOX[2] - y, 6)) & (lon > round(BOX[1] + x, 6)) & (lon < round(BOX[3] - x, 6))).select("stop_id")


@query("f14_cost_ceiling", "with c as (select *, min(o_totalprice) over (partition by o_custkey) as least, min(case when o_orderstatus = 'O' then o_totalprice end) over (partition by o_custkey) as best from orders) select o_orderkey from c where o_totalprice <= 1.5e0*least + 10 or o_totalprice = best")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    price = F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").withColumn("least", F.min(price).over(w)).withColumn("best", F.min(F.when(F.col("o_orderstatus") == "O", price)).over(w))
    return rows.where((price <= 1.5 * F.col("least") + 10) | (price == F.col("best"))).select("o_orderkey")


@query("f15_valid_records", "select event_id from events where try_cast(json_extract_string(props, '$.k') as bigint) is not null and length(event_type) > 0 and value >= 0")
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.expr("try_cast(get_json_object(props, '$.k') as bigint)").isNotNull() & (F.length("event_type") > 0) & (F.col("value") >= 0)).select("event_id")


@query("f16_dropped_addresses", "select p_partkey from part where p_partkey % 9 = 0 or not regexp_matches(cast(p_partkey as varchar), '^[1-9][0-9]{0,3}$') or regexp_matches(cast(p_partkey as varchar), '[0-9]{4}')")
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No street, no valid number, or four digits in a row."""
    number = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").where((F.col("p_partkey") % 9 == 0) | ~number.rlike(r"^[1-9]\d{0,3}$") | number.rlike(r"\d{4}")).select("p_partkey")


@query("f17_fresh_fixes", "select event_id, event_id % 400 > 60 as stale, event_id*13 % 500 > 300 as coarse, event_id % 400 > 30 as refresh from events")
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.col("event_id") % 400
    return table(spark, sf_dir, "events").select("event_id", (age > 60).alias("stale"), (F.col("event_id") * 13 % 500 > 300).alias("coarse"), (age > 30).alias("refresh"))


@query("j02_stop_coordinates", "select o.route_id, o.direction, o.seq, s.lat, s.lon from offs o join stop_leg s using (route_id, direction, seq)")
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_times(spark, sf_dir).join(stop_legs(spark, sf_dir).select("route_id", "direction", "seq", "lat", "lon"), ["route_id", "direction", "seq"]).select("route_id", "direction", "seq", "lat", "lon")


@query("j04_write_back", "with r as (select o_custkey, bool_or(o_orderkey % 11 = 0) as any_new, max(o_totalprice) as new_price from orders group by o_custkey) select o_orderkey, case when any_new then new_price else o_totalprice end as price from orders join r using (o_custkey)")
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values replaced only in groups where something was repaired."""
    orders = table(spark, sf_dir, "orders")
    repaired = orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderkey") % 11 == 0).alias("any_new"), F.max("o_totalprice").alias("new")).where("any_new")
    return orders.join(repaired, "o_custkey", "left").select("o_orderkey", F.coalesce("new", "o_totalprice").alias("price"))


@query("j09_run_through", f"""with e as (select route_id, direction, arg_min(stop_id, seq) as s_id, arg_min(lat, seq) as s_lat, arg_min(lon, seq) as s_lon, arg_max(stop_id, seq) as e_id, arg_max(lat, seq) as e_lat, arg_max(lon, seq) as e_lon, count(*) as n from stop_leg group by route_id, direction)
select a.route_id, a.direction, a.e_id as terminal, b.s_id as onward, a.n + b.n as n_stops from e a join e b on a.route_id = b.route_id and a.direction <> b.direction where {'2*6371000e0*asin(sqrt(pow(sin(radians(b.s_lat-a.e_lat)/2),2)+cos(radians(a.e_lat))*cos(radians(b.s_lat))*pow(sin(radians(b.s_lon-a.e_lon)/2),2)))'} <= 600""")
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions that go on as the other one: its first stop is within 600 m of their last."""
    ends = stop_legs(spark, sf_dir).groupBy("route_id", "direction").agg(F.min_by(F.struct("stop_id", "lat", "lon"), "seq").alias("s"), F.max_by(F.struct("stop_id", "lat", "lon"), "seq").alias("e"), F.count("*").alias("n"))
    on = ends.select("route_id", F.col("direction").alias("d2"), F.col("s").alias("s2"), F.col("n").alias("n2"))
    both = ends.join(on, "route_id").where("direction <> d2")
    near = geo.haversine(F.col("e.lat"), F.col("e.lon"), F.col("s2.lat"), F.col("s2.lon")) <= 600
    return both.where(near).select("route_id", "direction", F.col("e.stop_id").alias("terminal"), F.col("s2.stop_id").alias("onward"), (F.col("n") + F.col("n2")).alias("n_stops"))


@query("j20_name_lookup", "with name as (select distinct p_name as k, 'N' || p_name as v from part where p_partkey % 3 = 0), q as (select p_partkey, p_name || case when p_partkey % 2 = 0 then ' №' || p_size else '' end as q from part) select p_partkey, coalesce(a.v, b.v || ' ' || regexp_extract(q, '№([0-9]+)$', 1), q) as name from q left join name a on a.k = q left join name b on b.k = regexp_replace(q, ' №[0-9]+$', '')")
def j20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name as it is, or without its number, which is put back."""
    part = table(spark, sf_dir, "part")
    names = part.where("p_partkey % 3 = 0").select(F.col("p_name").alias("k"), F.concat(F.lit("N"), "p_name").alias("v")).distinct()
    asked = part.select("p_partkey", F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" №"), "p_size")).otherwise("")).alias("q"))
    asked = asked.withColumn("base", F.regexp_replace("q", r" №\d+$", ""))
    found = asked.join(names.withColumnsRenamed({"k": "q", "v": "direct"}), "q", "left").join(names.withColumnsRenamed({"k": "base", "v": "by_base"}), "base", "left")
    return found.select("p_partkey", F.coalesce("direct", F.concat("by_base", F.lit(" "), F.regexp_extract("q", r"№(\d+)$", 1)), "q").alias("name"))


@query("j21_next_bus", "select s.stop_id, min(o_orderkey) as next from stop_leg s join orders o on o.o_custkey = s.stop_id where o_orderkey > 500 group by s.stop_id")
def j21(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderkey > 500").groupBy(F.col("o_custkey").alias("stop_id")).agg(F.min("o_orderkey").alias("next"))
    return stop_legs(spark, sf_dir).select("stop_id").join(orders, "stop_id")


@query("j22_live_presence", "select c_custkey, case when o.o_custkey is null then 'unknown' when best is null then 'none' else 'live' end as state from customer left join (select o_custkey, max(case when o_orderstatus = 'O' then o_orderkey end) as best from orders group by o_custkey) o on o.o_custkey = c_custkey")
def j22(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("best"), F.lit(True).alias("known"))
    both = table(spark, sf_dir, "customer").join(boards, "c_custkey", "left")
    return both.select("c_custkey", F.when(F.col("known").isNull(), "unknown").when(F.col("best").isNull(), "none").otherwise("live").alias("state"))


@query("j25_search_without_recents", "select p_partkey, 1 as block from part where p_name like 'r%' and p_partkey not in (select p_partkey from part where p_size = 7) union all select p_partkey, 0 from part where p_size = 7")
def j25(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return search.after_recents(part.where(F.col("p_name").startswith("r")).select("p_partkey"), part.where("p_size = 7"), "p_partkey")


@query("j26_stops_of_line", "select stop_id from stop_leg where route_id = 9")
def j26(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stop_legs(spark, sf_dir).groupBy("stop_id").agg(F.collect_set("route_id").alias("lines"))
    return rows.where(F.array_contains("lines", 9)).select("stop_id")


@query("j27_lines_at_stop", "select user_id, event_type from (select *, row_number() over (partition by user_id, event_type order by event_id) as n from events) where n = 1")
def j27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_by(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type")


@query("j28_labels", "select l_orderkey, l_linenumber, p_name, s_name from lineitem left join part on p_partkey = l_partkey left join supplier on s_suppkey = l_suppkey")
def j28(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return lines.join(part, "l_partkey", "left").join(supplier, "l_suppkey", "left").select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("a05_modal_value", "select p_brand, p_type as value, n from (select p_brand, p_type, count(*) as n, row_number() over (partition by p_brand order by count(*) desc, p_type) as r from part group by p_brand, p_type) where r = 1")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy("p_brand", F.col("p_type").alias("value")).agg(F.count("*").alias("n"))
    return first_by(counts, ["p_brand"], F.col("n").desc(), "value").select("p_brand", "value", "n")


@query("a09_global_minima", "select o_custkey, min(o_totalprice) as least, min(case when o_orderstatus = 'O' then o_totalprice end) as least_open from orders group by o_custkey")
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("least"), F.min(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("least_open"))


@query("a11_coverage", "select case when p_size > 30 then 'exact' when p_size > 10 then 'near' else 'loose' end as tier, count(*) as n, count(*) filter (where p_partkey % 2 = 0) as named from part group by tier")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("p_size") > 30, "exact").when(F.col("p_size") > 10, "near").otherwise("loose")
    return resolve.coverage(table(spark, sf_dir, "part").withColumn("tier", tier), "tier", F.col("p_partkey") % 2 == 0)


@query("a13_distinct", "select distinct route_id, direction from stop_leg")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_legs(spark, sf_dir).select("route_id", "direction").distinct()


@query("a15_script_gate", "select lang, count(*) as n, count(*) filter (where regexp_matches(text, '[à-ÿ]')) as marked, count(*) filter (where regexp_matches(text, '[à-ÿ]')) >= 0.9*count(*) as passes from documents group by lang")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.script_gate(table(spark, sf_dir, "documents"), "lang", F.col("text"), "[à-ÿ]", 0.9)


@query("a16_journey_totals", "select l_orderkey, sum(l_quantity) as minutes, count(*) filter (where l_returnflag = 'N') as rides, round(sum(case when l_returnflag <> 'N' then l_extendedprice else 0 end), 2) as walk, string_agg(case when l_returnflag = 'N' then l_linenumber::varchar else '~' end, '>' order by l_linenumber, l_quantity, l_returnflag, l_extendedprice) as line_key from lineitem group by l_orderkey")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and the key of a journey's legs, folded over its array of legs."""
    legs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag", "l_extendedprice"))).alias("legs"))
    walk = F.aggregate(F.filter("legs", lambda x: x["l_returnflag"] != "N"), F.lit(0.0), lambda t, x: t + x["l_extendedprice"])
    key = F.array_join(F.transform("legs", lambda x: F.when(x["l_returnflag"] == "N", x["l_linenumber"].cast("string")).otherwise("~")), ">")
    minutes = F.aggregate("legs", F.lit(0.0), lambda t, x: t + x["l_quantity"])
    return legs.select("l_orderkey", minutes.alias("minutes"), F.size(F.filter("legs", lambda x: x["l_returnflag"] == "N")).cast("bigint").alias("rides"), F.round(walk, 2).alias("walk"), key.alias("line_key"))


@query("a18_street_names", "select p_brand, p_type as name from (select p_brand, p_type, row_number() over (partition by p_brand order by sum(p_size) desc, p_type) as r from part where p_size > 3 group by p_brand, p_type) where r <= 2")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = table(spark, sf_dir, "part").where("p_size > 3").groupBy("p_brand", F.col("p_type").alias("name")).agg(F.sum("p_size").alias("w"))
    return weight.withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("w").desc(), "name"))).where("r <= 2").select("p_brand", "name")


@query("a19_pole_groups", "select p_name as base, cast(sum(p_size) as bigint) as poles, string_agg(cast(p_partkey as varchar), ',' order by p_partkey) as ids from part group by p_name")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("base")).agg(F.sum("p_size").alias("poles"), F.array_join(F.sort_array(F.collect_list("p_partkey")), ",").alias("ids"))


@query("w06_prefix_best", "select l_orderkey, l_linenumber, min(l_extendedprice) over (partition by l_orderkey order by l_linenumber, l_extendedprice, l_partkey, l_suppkey rows unbounded preceding) as best from lineitem")
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.min("l_extendedprice").over(w).alias("best"))


@query("w07_suffix_best", "select l_orderkey, l_linenumber, min(l_extendedprice) over (partition by l_orderkey order by l_linenumber, l_extendedprice, l_partkey, l_suppkey rows between 1 following and unbounded following) as best from lineitem")
def w07(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey").rowsBetween(1, Window.unboundedFollowing)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.min("l_extendedprice").over(w).alias("best"))


@query("w11_first_per_id", "select user_id, event_id from (select *, row_number() over (partition by user_id order by value, event_id) as n from events) where n = 1")
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.struct("value", "event_id")).alias("b")).select("user_id", "b.event_id")


@query("w12_prefix_houses", "select p_brand, p_partkey, cast(n as bigint) as rank, 3 + n/100e0 as score from (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) as n from part where cast(p_size as varchar) like '1%') where n <= 8")
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").where(F.col("p_size").cast("string").startswith("1"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("bigint")).where("rank <= 8")
    return rows.select("p_brand", "p_partkey", "rank", (3 + F.col("rank") / F.lit(100.0)).alias("score"))


@query("w13_gaps", "select event_id, event_id - lag(event_id) over (partition by user_id order by event_id) as gap from events")
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))).alias("gap"))


@query("o02_natural_order", "select name, row_number() over (order by cast(regexp_extract(name, '^[0-9]+') as int), regexp_extract(name, '[A-Z]*$')) as place from (select distinct p_size || case when p_partkey % 3 = 0 then 'A' else '' end as name from part)")
def o02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers by their number, then their letter; lines are few."""
    name = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "A").otherwise(""))
    order = Window.orderBy(F.regexp_extract("name", r"^\d+", 0).cast("int"), F.regexp_extract("name", "[A-Z]*$", 0))
    return table(spark, sf_dir, "part").select(name.alias("name")).distinct().select("name", F.row_number().over(order).cast("bigint").alias("place"))


@query("o05_top_eight", "select p_partkey from part order by p_size, length(p_name), p_name, p_partkey limit 8")
def o05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").orderBy("p_size", F.length("p_name"), "p_name", "p_partkey").limit(8).select("p_partkey")


@query("o09_export_order", "select p_partkey, row_number() over (partition by p_brand order by p_name, p_size, p_partkey) as place from part")
def o09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_name", "p_size", "p_partkey")).cast("bigint").alias("place"))


@query("o10_recents", "with u as (select user_id, event_type, max(event_id) as last from events group by user_id, event_type) select user_id, event_type, place from (select *, row_number() over (partition by user_id order by last desc) as place from u) where place <= 3")
def o10(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("last").desc())).cast("bigint")).where("place <= 3").select("user_id", "event_type", "place")


@query("u01_gated_union", "select o_custkey, o_orderkey, 1 as kind from orders where o_orderstatus = 'P' union all select o_custkey, o_orderkey, 2 from orders o where o_orderstatus = 'O' and not exists (select 1 from orders p where p.o_custkey = o.o_custkey and p.o_orderstatus = 'P')")
def u01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second kind only where a key has none of the first."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    first = orders.where("o_orderstatus = 'P'").drop("o_orderstatus").withColumn("kind", F.lit(1))
    rest = orders.where("o_orderstatus = 'O'").drop("o_orderstatus").join(first.select("o_custkey").distinct(), "o_custkey", "left_anti").withColumn("kind", F.lit(2))
    return first.unionByName(rest)


@query("u03_candidates", "select 'part' as kind, p_partkey as id, p_name as name from part where p_size < 4 union all select 'supplier', s_suppkey, s_name from supplier union all select 'nation', cast(n_nationkey as bigint), n_name from nation")
def u03(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind, df, key, name: df.select(F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("id"), F.col(name).alias("name"))
    found = of("part", table(spark, sf_dir, "part").where("p_size < 4"), "p_partkey", "p_name")
    return found.unionByName(of("supplier", table(spark, sf_dir, "supplier"), "s_suppkey", "s_name")).unionByName(of("nation", table(spark, sf_dir, "nation"), "n_nationkey", "n_name"))


@query("u04_word_sets", "select p_partkey, list_sort(list_distinct(list_concat(w, ['new', 'gear']))) as joined, list_sort(list_filter(list_distinct(w), lambda x: x not in ('red', 'small'))) as kept, len(list_intersect(w, ['gear', 'bolt', 'hot'])) as shared from (select p_partkey, string_split(p_name, ' ') as w from part)")
def u04(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    lit = lambda *x: F.array(*map(F.lit, x))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_sort(F.array_union(words, lit("new", "gear"))).alias("joined"), F.array_sort(F.array_except(words, lit("red", "small"))).alias("kept"),
        F.size(F.array_intersect(words, lit("gear", "bolt", "hot"))).cast("bigint").alias("shared"),
    )


@query("u06_stale_keys", "select p_brand from part where p_size < 10 except select p_brand from part where p_size > 49")
def u06(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.where("p_size < 10").select("p_brand").subtract(part.where("p_size > 49").select("p_brand"))


@query("u07_joined_patterns", "select route_id, string_agg(cast(stop_id as varchar), ',' order by direction, seq) as stop_ids from stop_leg group by route_id")
def u07(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = lambda d: F.transform(F.sort_array(F.collect_list(F.when(F.col("direction") == d, F.struct("seq", "stop_id")))), lambda x: x["stop_id"])
    return stop_legs(spark, sf_dir).groupBy("route_id").agg(F.array_join(F.concat(chain(1), chain(2)), ",").alias("stop_ids"))


@query("p01_route_summary", "select route_id, count(distinct direction) as directions, count(*) as n_stops from stop_leg group by route_id")
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_legs(spark, sf_dir).groupBy("route_id").agg(F.countDistinct("direction").alias("directions"), F.count("*").alias("n_stops"))


@query("p13_steps", "select l_orderkey, l_linenumber, case when lag(l_suppkey) over w = l_suppkey then 'change here' when l_returnflag = 'N' then 'ride' else 'walk' end as step from lineitem window w as (partition by l_orderkey order by l_linenumber, l_extendedprice, l_partkey, l_suppkey)")
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    step = F.when(F.lag("l_suppkey").over(w) == F.col("l_suppkey"), "change here").when(F.col("l_returnflag") == "N", "ride").otherwise("walk")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", step.alias("step"))
