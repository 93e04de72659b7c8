"""Registration of queries, and the SQL of derived relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VIEWS = """with stop_leg as (
  select p_partkey as stop_id, p_partkey % 25 as route_id, cast(1 + floor(p_partkey/25e0) % 2 as int) as direction,
         cast(floor(p_partkey/50e0) as bigint) as seq,
         41.5e0 + (p_partkey % 25)*0.003e0 + (p_size % 7)*1e-5 as lat,
         41.5e0 + (case when floor(p_partkey/25e0) % 2 = 0 then floor(p_partkey/50e0)
                        else (select max(floor(p_partkey/50e0)) from part) - floor(p_partkey/50e0) end)*0.003e0 as lon
  from part),
shape_pt as (
  select route_id, case when route_id % 3 = 0 then -j else j end as i, lat, lon from (
    select route_id, case when direction = 1 then seq else 1000000 + seq end as j, 41.5e0 + route_id*0.003e0 as lat, lon from stop_leg) t),
dep as (select distinct o_orderkey % 25 as route_id, 300 + (o_orderkey*37) % 900 as dep from orders),
offs as (select route_id, direction, seq, case when route_id % 8 = 3 then cast(floor(seq/20e0) as bigint) else seq*2 end as off from stop_leg),
ping as (
  select event_id, user_id as plate, user_id % 25 as route_id, event_id*1000 as now_ms,
         41.5e0 + (user_id % 25)*0.003e0 as lat, 41.5e0 + ((event_id*7919) % 1200)/1e4 as lon from events)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; its SQL may use the derived views."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            text, views = sql.strip(), VIEWS
            if text.startswith("with recursive "):
                text, views = text.replace("with recursive ", "with ", 1), VIEWS.replace("with ", "with recursive ", 1)
            ORACLES[name] = f"{views},\n{text[5:]}" if text.startswith("with ") else f"{views}\n{text}"
        return f

    return add


def haversine(a: str, b: str, c: str, d: str) -> str:
    return f"(2*6371000e0*asin(sqrt(pow(sin(radians({c}-({a}))/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-({b}))/2),2))))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    return f"degrees(atan2(sin(radians({d}-({b})))*cos(radians({c})), cos(radians({a}))*sin(radians({c}))-sin(radians({a}))*cos(radians({c}))*cos(radians({d}-({b})))))"


#: Segments of the drawn lines, as CTEs after the views.
SEGMENTS = f"""with hop as (select *, coalesce({haversine("lag(lat) over w", "lag(lon) over w", "lat", "lon")}, 0e0) as hop,
  row_number() over w - 1 as n, count(*) over (partition by route_id) as size from shape_pt window w as (partition by route_id order by i)),
cum as (select *, sum(hop) over (partition by route_id order by i rows unbounded preceding) as along,
  max(case when n = floor(size/2e0) then lat end) over (partition by route_id) as mid from hop),
seg as (select * from (select route_id, n as seg, lag(lat) over w as a_lat, lag(lon) over w as a_lon, lat as b_lat, lon as b_lon,
  lag(along) over w as cum_a, along as cum_b, 111320e0*cos(radians(mid)) as scale from cum window w as (partition by route_id order by i)) where seg > 0)"""


def foot(lat: str, lon: str) -> str:
    """CTE text of each pair in ``pair`` (a point's columns and a segment's) with t, along and offset, as ``placed``."""
    return f"""plane as (select *, (b_lon-a_lon)*scale as bx, (b_lat-a_lat)*111320e0 as by_, ({lon}-a_lon)*scale as px, ({lat}-a_lat)*111320e0 as py from pair),
share as (select *, case when bx*bx+by_*by_ = 0 then 0e0 else greatest(0e0, least(1e0, (px*bx+py*by_)/(bx*bx+by_*by_))) end as t from plane),
placed as (select *, cum_a + t*(cum_b-cum_a) as along, sqrt(pow(px-bx*t,2)+pow(py-by_*t,2)) as off from share)"""
