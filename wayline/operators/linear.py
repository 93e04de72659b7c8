"""Linear referencing: lines as segment tables, projection, chains, slices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions import geo
from wayline.operators.carried import scan

CELL = 0.005
METRES_A_DEGREE = 110_000  #: of latitude, at most so many are padded for
#: Metres in which a stop's segments are looked up first, that a match may be behind the last one, and what a metre ahead costs.
NEARBY, BEHIND, AHEAD = 250.0, 60.0, 0.02


def cumulative(points: DataFrame, key: str = "route_id") -> DataFrame:
    """Adds ``hop`` and ``along``, the metres from the line's start, to ordered vertices (key, i, lat, lon)."""
    w = Window.partitionBy(key).orderBy("i")
    hop = F.coalesce(geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    return points.withColumn("hop", hop).withColumn("along", F.sum("hop").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def segments(points: DataFrame, key: str = "route_id") -> DataFrame:
    """A row per segment: key, seg, a_lat, a_lon, b_lat, b_lon, cum_a, cum_b, scale (metres per degree at the middle vertex)."""
    w = Window.partitionBy(key).orderBy("i")
    rows = cumulative(points, key).withColumn("n", F.row_number().over(w) - 1)
    middle = F.max(F.when(F.col("n") == F.floor(F.col("size") / 2), F.col("lat"))).over(Window.partitionBy(key))
    rows = rows.withColumn("size", F.count("*").over(Window.partitionBy(key))).withColumn("scale", geo.lon_scale(middle))
    return rows.select(
        key, F.col("n").cast("bigint").alias("seg"), F.lag("lat").over(w).alias("a_lat"), F.lag("lon").over(w).alias("a_lon"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"),
        F.lag("along").over(w).alias("cum_a"), F.col("along").alias("cum_b"), "scale",
    ).where("seg > 0")


def cell(x: Column) -> Column:
    return F.floor(x / CELL)


def near_segments(points: DataFrame, segs: DataFrame, reach: float, key: str = "route_id") -> DataFrame:
    """Points (key, lat, lon and more) with each segment of their own line within reach: adds the segment's columns, ``t``, ``along`` and ``offset``.

    Points and segments meet in grid cells, so a line's far segments are never compared.
    """
    pad = reach / METRES_A_DEGREE
    wide = pad / F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs(F.col("a_lat")), F.abs(F.col("b_lat"))) + pad)))
    rows = F.explode(F.sequence(cell(F.least("a_lat", "b_lat") - pad), cell(F.greatest("a_lat", "b_lat") + pad)))
    cols = F.explode(F.sequence(cell(F.least("a_lon", "b_lon") - wide), cell(F.greatest("a_lon", "b_lon") + wide)))
    dealt = segs.withColumn("cell_y", rows).withColumn("cell_x", cols)
    placed = points.withColumn("cell_y", cell(F.col("lat"))).withColumn("cell_x", cell(F.col("lon")))
    both = placed.join(dealt, [key, "cell_y", "cell_x"]).drop("cell_y", "cell_x")
    seg = {c: F.col(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon", "scale")}
    both = both.withColumn("t", geo.share_of_segment(F.col("lat"), F.col("lon"), seg))
    both = both.withColumn("offset", geo.offset_from_segment(F.col("lat"), F.col("lon"), seg, F.col("t"))).where(F.col("offset") <= reach)
    return both.withColumn("along", F.col("cum_a") + F.col("t") * (F.col("cum_b") - F.col("cum_a")))


def project(points: DataFrame, segs: DataFrame, reach: float, key: str = "route_id", point: str = "event_id") -> DataFrame:
    """Each point's nearest place on its own line, if within reach: adds ``seg``, ``along`` and ``offset``. At equal offset, to the millimetre, the first segment wins."""
    both = near_segments(points, segs, reach, key)
    best = F.min(F.struct(F.round("offset", 3).alias("o"), "seg", "along", "offset")).alias("best")
    return both.groupBy(point, key, *(c for c in points.columns if c not in (point, key))).agg(best).select(*points.columns, "best.seg", "best.along", "best.offset")


def slice_line(segs: DataFrame, spans: DataFrame, key: str = "route_id") -> DataFrame:
    """The vertices of each line between two places, both ends interpolated: span_id, ord, lat, lon. spans: span_id, key, start, stop."""
    both = segs.join(spans.where("stop > start"), key).where((F.col("cum_b") > F.col("start")) & (F.col("cum_a") < F.col("stop")) & (F.col("cum_b") > F.col("cum_a")))

    def at(metres: Column, name: str) -> Column:
        share = (metres - F.col("cum_a")) / (F.col("cum_b") - F.col("cum_a"))
        return F.col(f"a_{name}") + (F.col(f"b_{name}") - F.col(f"a_{name}")) * share

    low, high = F.greatest("start", "cum_a"), F.least("stop", "cum_b")
    first = F.when(F.col("cum_a") <= F.col("start"), F.array(F.struct(at(low, "lat").alias("lat"), at(low, "lon").alias("lon")))).otherwise(F.array().cast("array<struct<lat:double,lon:double>>"))
    ends = F.concat(first, F.array(F.struct(at(high, "lat").alias("lat"), at(high, "lon").alias("lon"))))
    each = both.select("span_id", "seg", F.posexplode(ends).alias("k", "p"))
    order = Window.partitionBy("span_id").orderBy("seg", "k")
    return each.select("span_id", (F.row_number().over(order) - 1).cast("bigint").alias("ord"), "p.lat", "p.lon")


def match_chain(stops: DataFrame, segs: DataFrame, key: str = "route_id") -> DataFrame:
    """Forward-only match of ordered stops (key, ord, lat, lon) to their line: key, ``ord``, ``along`` and ``offset``.

    Each stop takes the segment of least offset plus 2 % of the way ahead, not over 60 m behind the last match; past
    the line's end it stays, infinitely far off. A stop's segments within a reach are looked up in cells, and the match is a carried
    scan over them: a score up to that reach can't be beaten by a segment farther off. A line with a stop that nothing nearby serves
    is matched anew with all of its segments, as one group.
    """
    stops = stops.select(key, "ord", "lat", "lon")
    near = near_segments(stops, segs, NEARBY, key).groupBy(key, "ord").agg(F.sort_array(F.collect_list(F.struct("seg", "along", "offset"))).alias("near"))  # of one place

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        previous = state[0] if state else 0.0
        best = None
        for x in row[1] or ():
            if x["along"] >= previous - BEHIND:
                score = round(x["offset"] + AHEAD * max(0.0, x["along"] - previous), 6)
                if best is None or score < best[0]:
                    best = score, x["along"], x["offset"]
        if best is None or best[0] > NEARBY:
            return (previous,), (None, None, True)
        return (best[1],), (best[1], best[2], False)

    rows = stops.select(key, "ord").join(near, [key, "ord"], "left")
    found = scan(rows, key, ["ord"], ["near"], step, "previous double", "along double, offset double, far boolean")
    again = found.where("far").select(key).distinct()
    if again.isEmpty():
        return found.select(key, "ord", "along", "offset")
    whole = match_whole(stops.join(again, key, "left_semi"), segs.join(again, key, "left_semi"), key)
    return found.join(again, key, "left_anti").select(key, "ord", "along", "offset").unionByName(whole)


def match_whole(stops: DataFrame, segs: DataFrame, key: str) -> DataFrame:
    """The same match with all segments of a line, which is a group; those behind are not looked at."""
    key_type, ord_type = stops.schema[key].dataType.simpleString(), stops.schema["ord"].dataType.simpleString()

    def match(chain: pd.DataFrame, line: pd.DataFrame) -> pd.DataFrame:
        chain, line = chain.sort_values("ord"), line.sort_values("seg")
        scale = line["scale"].to_numpy()
        a_lat, a_lon, start, stop_at = (line[c].to_numpy() for c in ("a_lat", "a_lon", "cum_a", "cum_b"))
        bx, by = (line["b_lon"].to_numpy() - a_lon) * scale, (line["b_lat"].to_numpy() - a_lat) * geo.METRES_PER_DEGREE
        square, length = bx * bx + by * by, stop_at - start
        previous, out = 0.0, []
        for stop in chain.itertuples():
            k = np.searchsorted(stop_at, previous - BEHIND)  # the first segment that does not end before
            px, py = (stop.lon - a_lon[k:]) * scale[k:], (stop.lat - a_lat[k:]) * geo.METRES_PER_DEGREE
            t = np.clip(np.divide(px * bx[k:] + py * by[k:], square[k:], out=np.zeros_like(px), where=square[k:] > 0), 0, 1)
            along, offset = start[k:] + t * length[k:], np.hypot(px - bx[k:] * t, py - by[k:] * t)
            score = np.where(along >= previous - BEHIND, offset + AHEAD * np.maximum(0, along - previous), np.inf)
            if len(score) and np.isfinite(score).any():
                best = int(np.argmin(np.round(score, 6)))
                previous = float(along[best])
                out.append((previous, float(offset[best])))
            else:
                out.append((previous, np.inf))
        found = pd.DataFrame(out, columns=["along", "offset"], dtype="float64")
        return pd.concat([chain[[key, "ord"]].reset_index(drop=True), found], axis=1)

    return stops.groupBy(key).cogroup(segs.groupBy(key)).applyInPandas(match, f"{key} {key_type}, ord {ord_type}, along double, offset double")


def align(points: DataFrame, stops: DataFrame, key: str = "route_id") -> DataFrame:
    """The drawing order, as is or reversed, whose chain of stops fits better: key, reversed, cost."""
    both = points.withColumn("reversed", F.lit(0)).unionByName(points.withColumn("i", -F.col("i")).withColumn("reversed", F.lit(1)))
    line = F.concat_ws("/", F.col(key), F.col("reversed"))
    chains = stops.withColumn("reversed", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("line", line)
    matched = match_chain(chains, segments(both.withColumn("line", line), "line"), "line")
    cost = matched.groupBy("line").agg(F.sum(F.least(F.col("offset"), F.lit(500.0))).alias("cost"))
    parts = F.split("line", "/")
    cost = cost.select(parts[0].cast("bigint").alias(key), parts[1].cast("int").alias("reversed"), F.round("cost", 3).alias("cost"))
    best = cost.groupBy(key).agg(F.min(F.struct("cost", "reversed")).alias("b"))
    return best.select(key, F.col("b.reversed").alias("reversed"), F.col("b.cost").alias("cost"))
