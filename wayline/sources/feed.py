"""Nested feed documents as relations, generated fleets, and tables packed in tuples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STOP_ROUTE = "struct<Status:int,`Order`:bigint,times:array<string>>"
STOP = f"struct<id:string,BusStopNumber:bigint,nameKA:string,nameEN:string,lat:double,lon:double,routes:map<string,{STOP_ROUTE}>>"
ROUTE = "struct<id:string,nameKA:string,nameEN:string,RouteIsCircle:boolean,RouteSortOrder:bigint>"
POINTS = "array<struct<lat:double,lng:double>>"
DATASET = f"struct<busStops:map<string,{STOP}>,routesNames:map<string,{ROUTE}>,routeCoordinatesGrouped:map<string,{POINTS}>>"


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The network document, one row: data."""
    return spark.read.schema(f"data {DATASET}").option("multiLine", True).json(path)


def stops(dataset: DataFrame) -> DataFrame:
    return dataset.select(F.explode("data.busStops").alias("stop_id", "s")).select("stop_id", F.col("s.BusStopNumber").alias("code"), "s.nameKA", "s.nameEN", "s.lat", "s.lon")


def routes(dataset: DataFrame) -> DataFrame:
    return dataset.select(F.explode("data.routesNames").alias("route_id", "r")).select("route_id", F.col("r.nameEN").alias("name"), F.col("r.RouteIsCircle").alias("is_circle"), F.col("r.RouteSortOrder").alias("sort_order"))


def stop_routes(dataset: DataFrame) -> DataFrame:
    """A row per stop and route that the feed knows: direction 2 is status 2, all else 1."""
    each = dataset.select(F.explode("data.busStops").alias("stop_id", "s")).select("stop_id", F.explode("s.routes").alias("route_id", "x"))
    known = F.broadcast(routes(dataset).select("route_id"))  # lines of one city, tens of rows
    return each.join(known, "route_id").select("stop_id", "route_id", F.when(F.col("x.Status") == 2, 2).otherwise(1).alias("direction"), F.col("x.Order").alias("ord"), F.sort_array("x.times").alias("times"))


def shape_points(dataset: DataFrame) -> DataFrame:
    each = dataset.select(F.explode("data.routeCoordinatesGrouped").alias("route_id", "p"))
    return each.select("route_id", F.posexplode("p").alias("i", "x")).select("route_id", F.col("i").cast("bigint").alias("i"), "x.lat", F.col("x.lng").alias("lon"))


def fleet(segments: DataFrame, buses: int, elapsed_s: int, kmh: float = 20.0) -> DataFrame:
    """Buses at equal distances on each line, on their way for so long: route_id, bus, status, lat, lon."""
    length = segments.groupBy("route_id").agg(F.max("cum_b").alias("length"))
    each = length.select("route_id", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buses - 1).cast("bigint"))).alias("bus"))
    gone = each.withColumn("at", F.pmod(F.col("length") * F.col("bus") / buses + elapsed_s * kmh / 3.6, F.col("length")))
    on = gone.join(segments, "route_id").where((F.col("at") >= F.col("cum_a")) & (F.col("at") < F.col("cum_b")))
    share = (F.col("at") - F.col("cum_a")) / (F.col("cum_b") - F.col("cum_a"))
    between = lambda c: (F.col(f"a_{c}") + (F.col(f"b_{c}") - F.col(f"a_{c}")) * share).alias(c)
    return on.select("route_id", "bus", F.when(F.col("bus") == 0, 1).when(F.col("bus") == 1, 2).otherwise(-1).alias("status"), between("lat"), between("lon"))


def unpacked(rows: Column, origin: tuple[float, float], scale: float = 1e5) -> Column:
    """Structs of packed (number, dy, dx) runs: an array of texts, three for each entry after the first."""
    count = F.floor((F.size(rows) - 1) / 3).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        places,
        lambda i: F.struct(
            F.get(rows, i * 3 + 1).alias("number"), (F.lit(origin[0]) + F.get(rows, i * 3 + 2).cast("double") / scale).alias("lat"), (F.lit(origin[1]) + F.get(rows, i * 3 + 3).cast("double") / scale).alias("lon")
        ),
    )
