"""The reads that a client of the network makes, each a DataFrame of a fixed shape."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUTE = "route_id bigint, name string, n_stops bigint"
STOP = "stop_id bigint, lat double, lon double"
ROUTE_STOP = "route_id bigint, direction int, seq bigint, stop_id bigint, lat double, lon double"
STOP_LINE = "stop_id bigint, lat double, lon double, route_id bigint, direction int, seq bigint"
ARRIVAL = "stop_id bigint, route_id bigint, direction int, plate bigint, scheduled bigint, live bigint, place bigint"
TIMETABLE = "route_id bigint, direction int, offsets array<bigint>, departures array<bigint>"
VEHICLE = "plate bigint, route_id bigint, lat double, lon double"


def shaped(df: DataFrame, shape: str) -> DataFrame:
    """The columns of a shape, cast to its types; one that is missing raises an error."""
    return df.select(*(F.col(c).cast(kind).alias(c) for c, kind in (x.strip().split(" ", 1) for x in shape.split(","))))


@dataclass(frozen=True)
class Reads:
    """legs: route_id, direction, seq, stop_id, lat, lon; board: ``ARRIVAL``; patterns: ``TIMETABLE``; positions: ``VEHICLE``."""

    legs: DataFrame
    board: DataFrame
    patterns: DataFrame
    positions: DataFrame

    def routes(self) -> DataFrame:
        named = self.legs.groupBy("route_id").agg(F.count_distinct("stop_id").alias("n_stops"))
        return shaped(named.withColumn("name", F.concat(F.lit("Route "), "route_id")), ROUTE)

    def route(self, route_id: int) -> DataFrame:
        """A line's stops; filters reach the scan of the legs."""
        return shaped(self.legs.where(F.col("route_id") == route_id), ROUTE_STOP)

    def stops(self) -> DataFrame:
        return shaped(self.legs.groupBy("stop_id").agg(F.min(F.struct("lat", "lon")).alias("p")).select("stop_id", "p.*"), STOP)

    def stop(self, stop_id: int) -> DataFrame:
        """A stop with each line that calls there."""
        return shaped(self.legs.where(F.col("stop_id") == stop_id), STOP_LINE)

    def arrivals(self, stop_id: int) -> DataFrame:
        return shaped(self.board.where(F.col("stop_id") == stop_id), ARRIVAL)

    def timetable(self) -> DataFrame:
        return shaped(self.patterns, TIMETABLE)

    def vehicles(self, route_ids: Sequence[int] = ()) -> DataFrame:
        """Of the lines asked for; of all if none is."""
        rows = self.positions.where(F.col("route_id").isin(*route_ids)) if route_ids else self.positions
        return shaped(rows, VEHICLE)
