"""Keyed state over streams: vehicle tracks and published instants. The folds are those of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayline.operators import fleet

TRACK_COLUMNS = [c.split()[0] for c in fleet.TRACK_SCHEMA.split(", ")]


def ordered(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """All samples of one key in this batch; few, as a vehicle reports every few seconds."""
    return pd.concat(list(frames)).sort_values(by)


def clocked(samples: DataFrame) -> DataFrame:
    """The samples' own clock decides when state is forgotten; samples more than ten minutes late are dropped.

    A millisecond is added, as a watermark begins at the epoch and takes only what is later.
    """
    return samples.withColumn("at", F.timestamp_millis(F.col("now_ms") + 1)).withWatermark("at", "10 minutes")


def tracks(samples: DataFrame) -> DataFrame:
    """Every sample of a stream with its vehicle's state after it; the state of vehicles not seen for an hour goes.

    samples: event_id, plate, now_ms, lat, lon. Samples that come twice in a batch should be dropped before.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = tuple(None if pd.isna(x) else x for x in state.get) if state.exists else None
        rows = []
        for r in ordered(frames, ["now_ms", "event_id"]).itertuples():
            now = fleet.observe(now, r.lat, r.lon, r.now_ms)
            rows.append((r.event_id, key[0], r.now_ms, *now))
        state.update(now)
        state.setTimeoutTimestamp(now[5] + fleet.TRACK_TTL_MS)
        yield pd.DataFrame(rows, columns=TRACK_COLUMNS).astype({"heading": "float64", "speed_kmh": "float64"})

    return clocked(samples.select("event_id", "plate", "now_ms", "lat", "lon")).groupBy("plate").applyInPandasWithState(run, fleet.TRACK_SCHEMA, fleet.STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def published(raw: DataFrame) -> DataFrame:
    """Published instants of a stream of key, now_ms, raw_ms; those not renewed for a quarter of an hour are forgotten."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        shown, at = state.get if state.exists else (None, 0)
        rows = []
        for r in ordered(frames, ["now_ms", "raw_ms"]).itertuples():
            shown = fleet.eased(None if shown is None or r.now_ms - at > fleet.PUBLISHED_TTL_MS else shown, float(r.raw_ms))
            at = int(r.now_ms)
            rows.append((key[0], at, float(r.raw_ms), shown))
        state.update((shown, at))
        state.setTimeoutTimestamp(at + fleet.PUBLISHED_TTL_MS)
        yield pd.DataFrame(rows, columns=["key", "now_ms", "raw_ms", "shown_ms"])

    return clocked(raw).groupBy("key").applyInPandasWithState(run, "key bigint, now_ms bigint, raw_ms double, shown_ms double", "shown double, at bigint", "append", GroupStateTimeout.EventTimeTimeout)


def missed_polls(polls: DataFrame, key: str, silent_ms: int, missed: int = 3) -> DataFrame:
    """Runs of failed polls of a stream, and silences: key, event_id, at_ms, ``run`` and ``stale``.

    polls: key, event_id, now_ms, ok. Every poll gives a row with its run of failures so far; from ``missed`` on what is shown is stale.
    A line of which nothing comes for ``silent_ms`` is stale too: a timer gives a row without event_id, at the instant it ran out, and
    its state goes. Where a late batch holds the next poll before the timer could fire, that row is given first, so that the rows
    don't depend on how the stream is cut into batches. The last silences are told once the watermark has passed them.
    """
    kind = polls.schema[key].dataType.simpleString()
    columns = [key, "event_id", "at_ms", "run", "stale"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"event_id": "Int64"})

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            failed, last = state.get
            state.remove()
            yield frame([(name[0], None, last + silent_ms, failed, True)])
            return
        failed, last = state.get if state.exists else (0, None)
        rows = []
        for r in ordered(frames, ["now_ms", "event_id"]).itertuples():
            if last is not None and r.now_ms - last > silent_ms:
                rows.append((name[0], None, last + silent_ms, failed, True))
                failed = 0
            failed, last = 0 if r.ok else failed + 1, int(r.now_ms)
            rows.append((name[0], r.event_id, last, failed, failed >= missed))
        state.update((failed, last))
        state.setTimeoutTimestamp(last + silent_ms)
        yield frame(rows)

    form = f"{key} {kind}, event_id bigint, at_ms bigint, run bigint, stale boolean"
    return clocked(polls.select(key, "event_id", "now_ms", "ok")).groupBy(key).applyInPandasWithState(run, form, "failed bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout)
