"""The parquet tables, and transit relations derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUTES = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stop_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per route, direction and place in it: stop_id, route_id, direction, seq, lat, lon."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    seq = F.floor(F.col("p_partkey") / 50)
    outbound = F.floor(F.col("p_partkey") / 25) % 2 == 0
    last = F.broadcast(part.agg(F.max(seq).alias("last")))  # one row
    return part.crossJoin(last).select(
        F.col("p_partkey").alias("stop_id"), (F.col("p_partkey") % ROUTES).alias("route_id"),
        (1 + F.floor(F.col("p_partkey") / 25) % 2).cast("int").alias("direction"), seq.cast("bigint").alias("seq"),
        (F.lit(41.5) + (F.col("p_partkey") % ROUTES) * F.lit(0.003) + (F.col("p_size") % 7) * F.lit(1e-5)).alias("lat"),
        (F.lit(41.5) + F.when(outbound, seq).otherwise(F.col("last") - seq) * F.lit(0.003)).alias("lon"),
    )


def shape_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices of each route's line: route_id, i, lat, lon; every third line is drawn backwards."""
    j = F.when(F.col("direction") == 1, F.col("seq")).otherwise(1_000_000 + F.col("seq"))
    return stop_legs(spark, sf_dir).select(
        "route_id", F.when(F.col("route_id") % 3 == 0, -j).otherwise(j).alias("i"), (F.lit(41.5) + F.col("route_id") * F.lit(0.003)).alias("lat"), "lon"
    )


def departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-stop departures: route_id, dep (minutes)."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select((key % ROUTES).alias("route_id"), (300 + key * 37 % 900).alias("dep")).distinct()


def running_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published minutes from the first stop: route_id, direction, seq, off; every eighth route's are impossible."""
    off = F.when(F.col("route_id") % 8 == 3, F.floor(F.col("seq") / 20)).otherwise(F.col("seq") * 2).cast("bigint")
    return stop_legs(spark, sf_dir).select("route_id", "direction", "seq", off.alias("off"))


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicle samples: event_id, plate, route_id, now_ms, lat, lon."""
    user, event = F.col("user_id"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", user.alias("plate"), (user % ROUTES).alias("route_id"), (event * 1000).alias("now_ms"),
        (F.lit(41.5) + user % ROUTES * F.lit(0.003)).alias("lat"), (F.lit(41.5) + event * 7919 % 1200 / F.lit(10000.0)).alias("lon"),
    )
