"""Hand-made cases of the kernels, and plain folds beside them."""

import random

import pytest
from pyspark.sql import functions as F

from wayline.functions import clock, geo, text
from wayline.operators import distance, fleet, planner, resolve, search
from wayline.streaming import run, state


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_published_instants_are_eased(spark):
    raw = spark.createDataFrame([("a", 0, 300_000), ("a", 5, 310_000), ("a", 10, 360_000), ("a", 15, 280_000)], "key string, now_ms bigint, raw_ms bigint")
    assert [r.shown_ms for r in fleet.ratchet(raw).orderBy("now_ms").collect()] == [300_000, 300_000, 315_000, 280_000]


def test_speed_halves_in_a_minute_however_often_it_is_sampled():
    for every in (5_000, 20_000, 60_000):
        samples = [(41.6, 41.6, 0), (41.6 + 40 / 111_195, 41.6, 5_000)]
        samples += [(samples[1][0], 41.6, 5_000 + every * (k + 1)) for k in range(60_000 // every)]
        states = fleet.replay(iter(samples))
        assert states[-1][3] == pytest.approx(states[1][3] / 2)


def test_tracks_are_forgotten_after_an_hour():
    assert fleet.replay(iter([(41.6, 41.6, 0), (41.7, 41.6, 60_000), (41.8, 41.6, 60_000 + fleet.TRACK_TTL_MS + 1)]))[-1][3] is None


def test_stream_in_batches_equals_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, i % 7, i * 4_000, 41.6 + rng.random() / 200, 41.6) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id bigint, plate bigint, now_ms bigint, lat double, lon double")
    for k in range(3):
        df.where(f"event_id >= {k * 100} and event_id < {k * 100 + 100}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/events.parquet/{k}")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/events.parquet")
    found = {r.event_id: r for r in run.appended(state.tracks(stream)).collect()}
    want = {r.event_id: r for r in fleet.track(df).collect()}
    assert found.keys() == want.keys() and all(found[i] == want[i] for i in want)


def test_names_in_three_scripts(spark):
    say = lambda x: one(spark, x=text.to_cyrillic(F.lit(x))).x
    assert say("რუსთაველის ქუჩა") == "Улица Руставели"
    assert say("მე–18 საჯარო სკოლა") == "18-я публичная школа"
    assert say("Hotel 5") == "Hotel 5" and say("") == ""
    assert not any("ა" <= c <= "ჰ" for c in say("".join(map(chr, range(0x10D0, 0x10F1)))))
    keys = [one(spark, k=text.number_key(F.lit(x))).k for x in ("12ა", "12 а", "№12a", "#12 A")]
    assert len(set(keys)) == 1


def test_sounds_meet_across_scripts(spark):
    heard = lambda x: one(spark, s=text.sounds(text.fold(F.lit(x)))).s
    assert heard("Хилтон") == heard("Hilton") and heard("Шератон") == heard("Sheraton")


def places(spark):
    def record(rows, extra):
        df = spark.createDataFrame(rows, "id bigint, name string, lat double, lon double, " + extra)
        return df.withColumn("words", text.searchable(text.words(F.col("name"))))

    areas = record([(1, "Green Cape", 41.7, 41.7, True)], "settlement boolean")
    streets = record([(1, "Rustaveli", 41.6, 41.6, False), (2, "Rustaveli lane", 41.6, 41.6, True), (3, "26 May", 41.6, 41.6, False)], "lane boolean")
    houses = spark.createDataFrame([(1, 1, "12", 41.6, 41.6), (1, 2, "12ა", 41.6, 41.6), (1, 3, "120", 41.6, 41.6)], "street_id bigint, ord bigint, number string, lat double, lon double")
    named = record([(1, "Horizon", 41.6, 41.6, True), (2, "Hilton", 41.6, 41.6, False)], "prominent boolean").withColumn("types", F.array(F.lit("hotel")))
    return areas, streets, houses, named


def found(spark, *typed):
    asked = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(typed)], "query_id bigint, text string, lat double, lon double")
    out = {i: [] for i in range(len(typed))}
    for r in search.search(asked, *places(spark)).orderBy("query_id", "place").collect():
        out[r.query_id].append((r.kind, r.id))
    return [out[i] for i in range(len(typed))]


def test_search(spark):
    plain, house, letter, number, slip, soft, type_, heard, area = found(spark, "rustav", "rustaveli 12", "ул. Rustaveli 12A", "26 may", "horozon", "st.", "hotel", "Хилтон", "green")
    assert plain == [("street", "1"), ("street", "2")]  # the lane after its street
    assert house == [("address", "1/1"), ("address", "1/2"), ("address", "1/3"), ("street", "2")]
    assert letter[0] == ("address", "1/2")
    assert number == [("street", "3")] and slip == [("place", "1")] and soft == []
    assert type_ == [("place", "1"), ("place", "2")] and heard == [("place", "2")] and area == [("area", "1")]


def test_slip_index_misses_nothing(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(150)]
    df = spark.createDataFrame([(w,) for w in set(words)], "w string")
    both = df.join(df.withColumnRenamed("w", "t")).where(text.nearly(F.col("w"), F.col("t")))
    assert both.count() > 50
    assert both.where(~F.arrays_overlap(search.slip_keys(F.col("w")), search.slip_keys(F.col("t")))).count() == 0


def test_name_cascade(spark):
    known = spark.createDataFrame([(1, "რუსთაველის ქუჩა", "Руставели", 5), (2, "ზურაბ გორგილაძის ქუჩა", None, 9), (3, "№10 საჯარო სკოლა", "Школа 10", 1), (4, "დრამატული თეატრი", "Театр", 1)], "k_id bigint, k_name string, ru string, n bigint")
    names = [("რუსთაველის ქუჩა",), ("რუსთაველის ქუჩა #14",), ("ქუჩა რუსთაველის",), ("რუსთაველი ქუჩა",), ("№23 საჯარო სკოლა",), ("დრამატული თეტრი",)]
    hit = {r.name: (r.k_id, r.tier) for r in resolve.match_names(spark.createDataFrame(names, "name string"), known).collect()}
    assert hit == {names[0][0]: (1, "exact"), names[1][0]: (1, "near"), names[2][0]: (1, "reorder"), names[3][0]: (1, "stem"), names[5][0]: (4, "fuzzy")}


def test_pairs_within_a_distance(spark):
    rng = random.Random(8)
    rows = [(i, 41.6 + rng.random() / 40, 41.6 + rng.random() / 40) for i in range(120)]
    left = spark.createDataFrame(rows, "id bigint, lat double, lon double")
    right = left.withColumnsRenamed({"id": "r_id", "lat": "r_lat", "lon": "r_lon"})
    near = {(r.id, r.r_id) for r in distance.within(left, right, 400).collect()}
    want = left.join(right).where(geo.haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")) <= 400)
    assert near == {(r.id, r.r_id) for r in want.collect()}


def town(spark):
    """Line 1 drives east and back, line 2 north from its middle, line 3 takes line 1's way; 400 m between stops."""
    step = 400 / 111_195
    east = [(100 + i, 41.6, 41.6 + i * step / 0.7477) for i in range(8)]
    north = [(200 + i, 41.6 + (i + 1) * step, east[4][2]) for i in range(8)]
    rows = [(1, 1, i, *s) for i, s in enumerate(east)] + [(1, 2, i, *s) for i, s in enumerate(reversed(east))] + [(3, 1, i, *s) for i, s in enumerate(east)]
    rows += [(2, 1, i, *s) for i, s in enumerate([east[4], *north])]
    return spark.createDataFrame(rows, "route_id bigint, direction int, seq bigint, stop_id bigint, lat double, lon double"), east, north


def test_plans(spark):
    legs, east, north = town(spark)
    ask = [(1, *east[0][1:], *east[7][1:]), (2, *east[0][1:], *north[7][1:]), (3, *east[0][1:], east[0][1] + 0.001, east[0][2]), (4, *east[0][1:], 43.0, 43.0)]
    asked = spark.createDataFrame(ask, "query_id bigint, from_lat double, from_lon double, to_lat double, to_lon double")
    plans = {}
    for r in planner.plan(asked, legs).orderBy("query_id", "place").collect():
        plans.setdefault(r.query_id, []).append(r)
    direct, change = plans[1][0], plans[2][0]
    assert direct.n_rides == 1 and direct.rides[0].from_stop == 100 and direct.rides[0].to_stop == 107 and direct.also == [["3:1"]]
    assert change.n_rides == 2 and change.key in ("1:1>2:1", "3:1>2:1") and change.rides[1].to_stop == 207
    assert [r.key for r in plans[3]] == ["walk"] and 4 not in plans
    for rows in plans.values():
        assert all(r.minutes == pytest.approx(sum(x.minutes for x in r.rides) + sum(w.minutes for w in r.walks)) for r in rows)


def test_bus_drives_on_past_its_terminal(spark):
    legs, _, _ = town(spark)
    through = planner.build_patterns(legs).where("pattern = '1:1+'").orderBy("pos").collect()
    assert [r.stop_id for r in through] == [*range(100, 108), *range(106, 99, -1)] and {r.turns_at for r in through} == {7}


def test_next_departure_and_labels(spark):
    r = one(
        spark, a=clock.next_departure(F.array(*map(F.lit, (400, 500, 700))), F.lit(480)), b=clock.next_departure(F.array(F.lit(400)), F.lit(480)), c=clock.to_clock(F.lit(1450)), d=clock.duration(F.lit(61.5)), e=clock.ordinal(F.lit(112)),
        f=clock.distance_label(F.lit(1549.0)),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (20, 1360, "00:10", "1 h 2 min", "112th", "1.5 km")


def test_clusters_of_a_long_shuffled_chain(spark):
    """A thousand points in a line with ids in no order are one cluster; another name beside them is another."""
    rng = random.Random(5)
    ids = list(range(1000))
    rng.shuffle(ids)
    rows = [(i, "a", 41.5, 41.5 + k * 0.001) for k, i in enumerate(ids)] + [(5000, "b", 41.5, 41.5), (5001, "a", 42.5, 41.5)]
    found = {r.point_id: r.cluster for r in resolve.clusters(spark.createDataFrame(rows, "point_id bigint, name string, lat double, lon double"), 260).collect()}
    assert found == {**dict.fromkeys(range(1000), 0), 5000: 5000, 5001: 5001}


@pytest.mark.parametrize("at", [0.0, 41.5, 69.6, -85.0, 89.5])
def test_pairs_in_reach_at_any_latitude(spark, at):
    """Also over the line where longitudes begin anew."""
    rng = random.Random(3)
    points = [(i, at + rng.uniform(-0.02, 0.02), rng.choice([-180, 179.9, 0, 20]) + rng.uniform(0, 0.1)) for i in range(150)]
    points = [(i, min(90.0, lat), lon) for i, lat, lon in points]
    want = {(a, b) for a, x, y in points for b, u, v in points if fleet.metres(x, y, u, v) <= 900}
    left = spark.createDataFrame(points, "a bigint, lat double, lon double")
    right = spark.createDataFrame(points, "b bigint, r_lat double, r_lon double")
    found = [(r.a, r.b) for r in distance.within(left, right, 900).collect()]
    assert len(found) == len(set(found)) and set(found) == want
