"""Joins by distance, nearest neighbours and dominance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions import geo


def within(left: DataFrame, right: DataFrame, metres: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs of (lat, lon) and (r_lat, r_lon) rows at most so far apart, and equal in the columns ``on``, with ``metres``.

    Both sides meet in grid cells at least that wide, whose degrees of longitude grow with the band's latitude; the left
    row goes to its own and the eight around, round the globe, so the join is an equi-join of cells and no pair is missed
    or made twice.
    """
    size = metres / 110_000  # degrees of latitude that are at least so many metres
    band = lambda lat: F.floor(lat / size)
    poleward = lambda y: F.least(F.lit(89.9), (F.abs(y + 0.5) + 1.5) * size)  # noqa: E731  the latitude farthest north or south that the band or the next reaches
    width = lambda y: F.least(F.lit(360.0), size / F.cos(F.radians(poleward(y))))
    last = F.floor(F.lit(180.0) / width(F.col("_y")))
    x = lambda lon: F.floor(lon / width(F.col("_y")))
    around = F.flatten(F.transform(F.array(F.col("lon") - 360, F.col("lon"), F.col("lon") + 360), lambda lon: F.sequence(x(lon) - 1, x(lon) + 1)))
    around = F.array_distinct(F.filter(around, lambda c: (c >= -last - 1) & (c <= last)))
    l_ = left.withColumn("_y", F.explode(F.sequence(band(F.col("lat")) - 1, band(F.col("lat")) + 1))).withColumn("_x", F.explode(around))
    r_ = right.withColumn("_y", band(F.col("r_lat"))).withColumn("_x", x(F.col("r_lon")))
    both = l_.join(r_, ["_y", "_x", *on]).drop("_y", "_x")
    return both.withColumn("metres", geo.haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))).where(F.col("metres") <= metres)


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def first_few(df: DataFrame, keys: Sequence[str], n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each key in an order; the window keeps no more of them in each task."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def access(points: DataFrame, stops: DataFrame, near: float = 1200, far: float = 3000, most: int = 3) -> DataFrame:
    """Stops that a point walks to: all within ``near``, or where there is none the nearest ``most`` within ``far``."""
    both = within(points, stops, far)
    w = Window.partitionBy("point_id")
    both = both.withColumn("_near", F.count_if(F.col("metres") <= near).over(w)).withColumn("_rank", F.row_number().over(w.orderBy(F.round("metres", 3), "stop_id")))
    return both.where(((F.col("_near") > 0) & (F.col("metres") <= near)) | ((F.col("_near") == 0) & (F.col("_rank") <= most))).drop("_near", "_rank")


def skyline(options: DataFrame, key: str, costs: Sequence[str], slack: dict[str, float]) -> DataFrame:
    """Rows that no other of their key beats: at most equal in all costs and less in one, by more than its slack if it has one.

    What beats a row comes before it in the order of all costs, and what is beaten beats nothing that its better doesn't: a task streams
    its keys in this order and holds the unbeaten rows of one key. Costs may not be null.
    """
    margins = [slack.get(c, 0.0) for c in costs]

    def beats(a: tuple, b: tuple) -> bool:
        return all(x <= y for x, y in zip(a, b, strict=True)) and any(x < y - m for x, y, m in zip(a, b, margins, strict=True))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, front, first = None, [], True
        for batch in batches:
            kept = []
            for name, *row in zip(*(batch.column(c).to_pylist() for c in (key, *costs)), strict=True):
                if first or name != own:
                    own, front, first = name, [], False
                kept.append(not any(beats(x, row) for x in front))
                if kept[-1]:
                    front.append(row)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return options.repartition(key).sortWithinPartitions(key, *costs).mapInArrow(sweep, options.schema)
