"""Vehicles: direction, state over time, and arrival estimates."""

from __future__ import annotations

from collections.abc import Iterator
from math import asin, atan2, cos, degrees, radians, sin, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions import geo
from wayline.operators.carried import scan

MOVED_METRES, HALF_LIFE_MS, FASTEST_KMH = 12.0, 60_000.0, 90.0
DEADBAND_MS, EASE = 20_000.0, 0.25
#: A vehicle not seen, and an instant not published, for longer than this is forgotten.
TRACK_TTL_MS, PUBLISHED_TTL_MS = 3_600_000, 900_000
TRACK_SCHEMA = "event_id bigint, plate bigint, now_ms bigint, lat double, lon double, heading double, speed_kmh double, moved_ms bigint, seen_ms bigint, first_ms bigint"
STATE_SCHEMA = "lat double, lon double, heading double, speed_kmh double, moved_ms bigint, seen_ms bigint, first_ms bigint"
State = tuple[float, float, float | None, float | None, int, int, int]


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b = radians(lat1), radians(lat2)
    h = sin((b - a) / 2) ** 2 + cos(a) * cos(b) * sin(radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.EARTH_RADIUS * asin(sqrt(h))


def heading(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b, d = radians(lat1), radians(lat2), radians(lon2 - lon1)
    return degrees(atan2(sin(d) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(d)))


def observe(state: State | None, lat: float, lon: float, now: int) -> State:
    """A vehicle's state after a sample: speed decays while it stands, and is smoothed when it has moved."""
    if state is None or now - state[5] > TRACK_TTL_MS:
        return (lat, lon, None, None, now, now, now)
    at_lat, at_lon, head, speed, moved, seen, first = state
    gone = metres(at_lat, at_lon, lat, lon)
    if gone < MOVED_METRES:
        return (at_lat, at_lon, head, None if speed is None else speed * 0.5 ** ((now - seen) / HALF_LIFE_MS), moved, now, first)
    kmh = min(FASTEST_KMH, gone / max(1.0, (now - moved) / 1000) * 3.6)
    return (lat, lon, heading(at_lat, at_lon, lat, lon), kmh if speed is None else 0.6 * speed + 0.4 * kmh, now, now, first)


def track(samples: DataFrame) -> DataFrame:
    """Every sample with its vehicle's state after it. samples: event_id, plate, now_ms, lat, lon."""

    def step(state: State | None, row: tuple) -> tuple[State, State]:
        after = observe(state, row[2], row[3], row[0])
        return after, after

    found = scan(samples, "plate", ["now_ms", "event_id"], ["lat", "lon"], step, STATE_SCHEMA, STATE_SCHEMA)
    return found.select(*(c.split()[0] for c in TRACK_SCHEMA.split(", ")))


def eased(shown: float | None, raw: float) -> float:
    """The instant to publish: sooner at once, a little later held, much later eased in."""
    if shown is None or raw <= shown:
        return raw
    return shown if raw - shown < DEADBAND_MS else shown + EASE * (raw - shown)


def ratchet(raw: DataFrame, key: str = "key") -> DataFrame:
    """Published instants: sooner at once, a little later held, much later eased in. raw: key, now_ms, raw_ms.

    A null instant is published as null and changes nothing.
    """

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        before = state[0] if state else None
        shown = before if row[1] is None else eased(before, row[1])
        return (shown,), (None if row[1] is None else shown,)

    rows = raw.select(key, "now_ms", F.col("raw_ms").cast("double").alias("raw_ms"))
    return scan(rows, key, ["now_ms", "raw_ms"], [], step, "shown double", "shown_ms double")


def in_service(standing_s: Column, age_s: Column) -> Column:
    return (standing_s < 600) | (age_s < 120)


def estimate_seconds(distance: Column, kmh: Column, between: Column, standing_s: Column) -> Column:
    """Time of arrival along the line: running time, 15 s a stop, and standing beyond 45 s."""
    v = F.least(F.lit(45.0), F.greatest(F.lit(10.0), F.coalesce(kmh, F.lit(18.0))))
    return F.greatest(F.lit(0.0), distance) / 1000 / v * 3600 + 15 * between + F.greatest(F.lit(0.0), standing_s - 45)


def asof_along(stops: DataFrame, vehicles: DataFrame, on: list[str], passed: float = 40.0) -> DataFrame:
    """For each stop the vehicle of its line that is nearest and has not passed it: adds the vehicle's columns and ``distance``.

    stops: on, along and more; vehicles: on, plate, v_along and more. Ties go to the first plate. Stops and vehicles lie in one
    order along the line, and each stop takes the last vehicle before it: no pairs are made.
    """
    rest = [c for c in vehicles.columns if c not in on]
    own = [c for c in stops.columns if c not in on]
    points = stops.select(*on, (F.col("along") + passed).alias("_pos"), F.lit(1).alias("_kind"), F.struct(*own).alias("_stop"))
    moving = vehicles.select(*on, F.col("v_along").alias("_pos"), F.lit(0).alias("_kind"), F.struct(*rest).alias("_vehicle"))
    order = Window.partitionBy(*on).orderBy("_pos", "_kind", F.col("_vehicle.plate").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = points.unionByName(moving, allowMissingColumns=True).withColumn("_last", F.last("_vehicle", ignorenulls=True).over(order))
    found = both.where("_kind = 1 and _last is not null").select(*on, "_stop.*", "_last.*")
    return found.withColumn("distance", F.col("along") - F.col("v_along"))


def stops_up_to(stops: DataFrame, vehicles: DataFrame, on: list[str]) -> DataFrame:
    """The vehicles with ``n_passed``, the stops of their line at their place or before."""
    points = stops.select(*on, F.col("along").alias("_pos"), F.lit(0).alias("_kind"))
    moving = vehicles.select(*on, F.col("v_along").alias("_pos"), F.lit(1).alias("_kind"), F.struct(*vehicles.columns).alias("_vehicle"))
    order = Window.partitionBy(*on).orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = points.unionByName(moving, allowMissingColumns=True).withColumn("n_passed", F.count_if(F.col("_kind") == 0).over(order))
    return both.where("_kind = 1").select("_vehicle.*", "n_passed")


def replay(samples: Iterator[tuple[float, float, int]]) -> list[State]:
    """States of one vehicle, for tests."""
    out, state = [], None
    for lat, lon, now in samples:
        state = observe(state, lat, lon, now)
        out.append(state)
    return out
