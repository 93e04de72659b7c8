"""Carried state over ranges, against the plain fold."""

import random

import pytest

from wayline.operators import carried, fleet
from wayline.plans import scalars


@pytest.fixture
def ranges(spark):
    """Ranges stay as they are dealt, however small."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def step(state, row):
    """A sum that doubles what it has, so that order matters; a null adds nothing and gives nothing."""
    total = (state[0] if state else 0) * 2 % 1_000_003
    total += 0 if row[1] is None else row[1]
    return (total,), (None if row[1] is None else total, len(row))


def test_a_hot_key_goes_over_many_ranges(spark, ranges):
    rng = random.Random(7)
    for share in (0.0, 0.5, 1.0):
        rows = [("hot" if rng.random() < share else rng.choice(["a", "b", "c", None, ""]), k // 2, rng.choice([None, *range(50)]), "x") for k in range(1200)]
        df = spark.createDataFrame(rows, "k string, at int, v int, total string").repartition(3)
        found = carried.scan(df, "k", ["at"], ["v"], step, "total bigint", "total bigint, n int").collect()
        want = []
        for key in {r[0] for r in rows}:
            state = None
            for _, at, v, _ in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2] is not None, r[2] or 0)):
                state, out = step(state, (at, v))
                want.append((key, at, *out))
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert carried.scan(df.where("false"), "k", ["at"], ["v"], step, "total bigint", "total bigint, n int").count() == 0


def test_tracks_over_ranges(spark, ranges):
    rng = random.Random(3)
    rows = [(k, k % 2 if k % 9 == 0 else 5, k * 20_000 + (4_000_000 if k > 400 else 0), 41.6 + rng.random() / 300, 41.6) for k in range(600)]
    found = {r.event_id: r for r in fleet.track(spark.createDataFrame(rows, "event_id bigint, plate bigint, now_ms bigint, lat double, lon double")).collect()}
    for plate in (0, 1, 5):
        own = [r for r in rows if r[1] == plate]
        for r, state in zip(own, fleet.replay((r[3], r[4], r[2]) for r in own), strict=True):
            assert tuple(found[r[0]])[3:] == state


def test_a_bearing_is_never_a_whole_turn(spark, tmp_path):
    """A reading of 0 that is reached from just above it: the sum is a little below 0."""
    events = [(0, 1), (2, 1), (4320, 1)]
    spark.createDataFrame(events, "event_id bigint, user_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    found = {r.event_id: r.degrees for r in scalars.w15(spark, str(tmp_path)).collect()}
    assert found == {0: 0.0, 2: 1.223112, 4320: 0.0}
