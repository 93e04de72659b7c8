"""Queries on streams. Each runs its stream over the table's files until they are used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.plans.base import query
from wayline.plans.board import RAW, TRACK
from wayline.sources.tables import ROUTES, table
from wayline.streaming import run, state


def ping_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicle samples as they come: event_id, plate, route_id, now_ms, lat, lon."""
    user, event = F.col("user_id"), F.col("event_id")
    return run.table_stream(spark, sf_dir, "events").select(
        "event_id", user.alias("plate"), (user % ROUTES).alias("route_id"), (event * 1000).alias("now_ms"),
        (F.lit(41.5) + user % ROUTES * F.lit(0.003)).alias("lat"), (F.lit(41.5) + event * 7919 % 1200 / F.lit(10000.0)).alias("lon"),
    )


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a time that takes a watermark."""
    return run.table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")


@query("r01_track_stream", f"""{TRACK}
select event_id, plate, now_ms, lat, lon, round(heading, 3) as heading, round(speed, 3) as speed_kmh, moved as moved_ms, seen as seen_ms, began as first_ms from run""")
def r01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each vehicle after every sample, kept between batches."""
    return run.appended(state.tracks(ping_stream(spark, sf_dir))).withColumns({"heading": F.round("heading", 3), "speed_kmh": F.round("speed_kmh", 3)})


@query("r03_ratchet_stream", f"""with recursive {RAW}, x as (select *, row_number() over (partition by key order by now_ms) as n from raw),
step as (select key, n, now_ms, cast(raw_ms as double) as raw_ms, cast(raw_ms as double) as shown_ms from x where n = 1
 union all select x.key, x.n, x.now_ms, cast(x.raw_ms as double), case when x.raw_ms <= step.shown_ms then x.raw_ms when x.raw_ms - step.shown_ms < 20000 then step.shown_ms else step.shown_ms + 0.25e0*(x.raw_ms - step.shown_ms) end from step join x on x.key = step.key and x.n = step.n + 1)
select key, now_ms, raw_ms, round(shown_ms, 3) as shown_ms from step""")
def r03(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    raw = run.table_stream(spark, sf_dir, "events").select((e % 200).alias("key"), e.alias("now_ms"), (e * 1000 + e * 7919 % 90000).alias("raw_ms"))
    return run.appended(state.published(raw)).withColumn("shown_ms", F.round("shown_ms", 3))


@query("r05_standing", "select event_id, true as fresh from events")
def r05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample is never older than its vehicle's last move, nor this than the first sight of it."""
    seen = run.appended(state.tracks(ping_stream(spark, sf_dir)))
    return seen.select("event_id", ((F.col("now_ms") >= F.col("moved_ms")) & (F.col("moved_ms") >= F.col("first_ms"))).alias("fresh"))


@query("r07_once_a_minute", "select user_id, count(distinct date_trunc('minute', ts)) as minutes from events group by user_id")
def r07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of one vehicle and minute that come twice are one."""
    once = timed(spark, sf_dir).select("user_id", "ts", F.date_trunc("minute", "ts").alias("minute")).dropDuplicates(["user_id", "minute"])
    return run.appended(once.select("user_id", "minute")).groupBy("user_id").agg(F.count("*").alias("minutes"))


DAY_MS = 86_400_000


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a poll of its user's line, which failed if it is an error."""
    return run.table_stream(spark, sf_dir, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("now_ms"), (F.col("event_type") != "error").alias("ok"))


@query("r08_missed_polls", f"""with e as (select user_id, event_id, epoch_us(ts) // 1000 as at_ms, event_type = 'error' as failed from events),
g as (select *, at_ms - lag(at_ms) over w > {DAY_MS} as anew, lead(at_ms) over w as next_ms from e window w as (partition by user_id order by at_ms, event_id)),
i as (select *, sum(case when anew or not failed then 1 else 0 end) over (partition by user_id order by at_ms, event_id rows unbounded preceding) as island from g),
r as (select *, cast(sum(case when failed then 1 else 0 end) over (partition by user_id, island order by at_ms, event_id rows unbounded preceding) as bigint) as run from i)
select user_id, event_id, at_ms, run, run >= 3 as stale from r
union all select user_id, null, at_ms + {DAY_MS}, run, true from r where next_ms - at_ms > {DAY_MS} or (next_ms is null and at_ms + {DAY_MS} < (select max(at_ms) + 1 - 600000 from e))""")
def r08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose polls fail three times, or of which nothing comes for a day."""
    return run.appended(state.missed_polls(polls(spark, sf_dir), "user_id", DAY_MS))


@query("r08_failure_runs", "with g as (select event_id, user_id, event_type, count(*) filter (where event_type <> 'error') over (partition by user_id order by event_id rows unbounded preceding) as g from events) select event_id, cast(case when event_type = 'error' then row_number() over (partition by user_id, g, event_type = 'error' order by event_id) else 0 end as bigint) as run, event_type = 'error' and row_number() over (partition by user_id, g, event_type = 'error' order by event_id) >= 3 as stale from g")
def r08_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as of the table (``w17_failure_runs``), from a stream in which no silence is too long."""
    return run.appended(state.missed_polls(polls(spark, sf_dir), "user_id", 365 * DAY_MS)).select("event_id", "run", "stale")


@query("r09_countdowns", "select event_id, greatest(0, (event_id*1000 % 600000 - 60000) // 60000) as minutes from events where event_id*1000 % 600000 >= 60000")
def r09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants still to come, as minutes from a given now."""
    left = F.col("event_id") * 1000 % 600000 - 60000
    rows = run.table_stream(spark, sf_dir, "events").select("event_id", left.alias("left")).where("left >= 0")
    return run.appended(rows.select("event_id", F.greatest(F.lit(0).cast("bigint"), F.floor(F.col("left") / 60000)).alias("minutes")))


@query("r10_hourly_counts", "select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 2) as total from events group by hour, event_type")
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = timed(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("sum"))
    last = run.upserted(hours.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "sum"), ["hour", "event_type"])
    return last.select("hour", "event_type", "n", F.round("sum", 2).alias("total"))


@query("r11_sessions", "select user_id, min(ts) as begin, count(*) as n from (select *, sum(case when gap then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as s from (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 6 hour, true) as gap from events)) group by user_id, s")
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events less than six hours apart (of a table: streams give sessions only once they are over)."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    held = rows.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return held.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("begin"), "n")
