"""Close words, skylines, spaced rows, chains on lines, boxes and names, against plain Python."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from wayline.operators import areas, close, distance, linear, resolve
from wayline.sources import names, reads


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_close_words_are_all_found(spark):
    rng = random.Random(4)
    words = {"".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(150)} | {"გზატკეცილი", "გზატკეცლი", ""}
    others = {"".join(rng.choices("abc", k=rng.randint(3, 8))) for _ in range(80)} | words
    frame = lambda xs: spark.createDataFrame([(w, 1) for w in [*xs, None]], "w string, a int")
    found = close.close_words(frame(words), frame(others)).collect()
    want = {(a, b) for a in words for b in others if a == b or (min(len(a), len(b)) >= 5 and edits(a, b) <= 2)}
    assert {(r.a, r.b) for r in found} == want and len(found) == len(want)


def test_skyline(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([1, 2, None]), rng.randint(0, 12), rng.randint(0, 3), rng.randint(0, 9) / 2, ["x"]) for k in range(300)]
    found = distance.skyline(spark.createDataFrame(rows, "id int, q int, minutes int, rides int, walk double, more array<string>").repartition(3), "q", ["minutes", "rides", "walk"], {"minutes": 2, "walk": 2})

    def beats(a, b):
        return all(x <= y for x, y in zip(a[2:5], b[2:5], strict=True)) and (a[2] < b[2] - 2 or a[3] < b[3] or a[4] < b[4] - 2)

    assert sorted(r.id for r in found.collect()) == [r[0] for r in rows if not any(o[1] == r[1] and beats(o, r) for o in rows)]


@pytest.mark.parametrize("metres", [120.0, 900.0])
def test_spaced_rows(spark, metres):
    rng = random.Random(6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    rows = [("a" if k % 3 else None, k % 2, k, 62.0 + rng.random() / 50, 20 + rng.random() / 50) for k in range(400)]
    found = resolve.spread(spark.createDataFrame(rows, "town string, side int, at int, lat double, lon double").repartition(4), ["town", "side"], "at", metres).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = {}
    for town, side, at, lat, lon in rows:
        kept = want.setdefault((town, side), [])
        if not any(math.hypot((lon - o) * 111_320 * math.cos(math.radians((lat + a) / 2)), (lat - a) * 111_320) < metres for _, a, o in kept):
            kept.append((at, lat, lon))
    assert sorted((str(r.town), r.side, r.at) for r in found) == sorted((str(t), s, at) for (t, s), kept in want.items() for at, *_ in kept)


def test_chains_that_leave_their_line_are_matched_whole(spark):
    """A line up and down again; stops near it, far from it, in the wrong order, and a line without stops nearby at all."""
    rng = random.Random(7)
    up = [(41.6 + k * 0.004, 41.6) for k in range(12)]
    line = [*up, *((a, o + 0.0002) for a, o in reversed(up))]
    points = spark.createDataFrame([(r, i, *p) for r in (1, 2, 3, 4) for i, p in enumerate(line)], "route_id bigint, i bigint, lat double, lon double")
    near = [(1, k, 41.6 + k * 0.002, 41.6003) for k in range(20)] + [(1, 100 + k, 41.64 - k * 0.002, 41.5999) for k in range(20)]
    odd = [(2, k, 41.6 + rng.random() / 20, 41.6 + rng.random() / 100) for k in range(25)] + [(3, k, 41.7, 41.7) for k in range(3)]
    stops = spark.createDataFrame([*near, *odd], "route_id bigint, ord bigint, lat double, lon double")
    segs = linear.segments(points)
    found = {(r.route_id, r.ord): (round(r.along, 6), round(r.offset, 6)) for r in linear.match_chain(stops, segs).collect()}
    whole = {(r.route_id, r.ord): (round(r.along, 6), round(r.offset, 6)) for r in linear.match_whole(stops, segs, "route_id").collect()}
    assert found == whole and len(found) == len(near) + len(odd)
    alongs = [found[1, k][0] for k in (*range(20), *range(100, 120))]
    assert alongs == sorted(alongs)


def test_boxes_of_all_sizes(spark):
    rng = random.Random(8)
    boxes = []
    for k in range(60):
        south, west, size = rng.uniform(-80, 80), rng.uniform(-170, 170), 10 ** rng.uniform(-4, 2)
        boxes.append((k, south, min(90.0, south + size), west, min(180.0, west + size * rng.uniform(0.1, 3))))
    points = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(200)] + [(1000 + k, b[1] if k % 2 else b[2], b[3] if k % 3 else b[4]) for k, b in enumerate(boxes)]
    found = areas.in_boxes(spark.createDataFrame(points, "point_id int, lat double, lon double"), spark.createDataFrame(boxes, "area_id int, south double, north double, west double, east double")).collect()
    want = [(p, a) for p, lat, lon in points for a, s, n, w, e in boxes if s <= lat <= n and w <= lon <= e]
    assert sorted((r.point_id, r.area_id) for r in found) == sorted(want)


def test_names_table_and_lookups(spark, tmp_path):
    table = {"meta": {"attribution": "x"}, "names": {"რუსთაველის ქუჩა": {"ru": "Улица Руставели", "en": "Rustaveli Street", "src": "map"}, "ბაზარი #2": {"ru": "Рынок 2", "en": ""}, "№5 სკოლა": {"en": "School 5"}}}
    (tmp_path / "names.json").write_text(json.dumps(table, indent=1, ensure_ascii=False))
    known = names.read_names(spark, f"file://{tmp_path}/names.json")
    assert known.count() == 3
    asked = ["რუსთაველის ქუჩა", " რუსთაველის  ქუჩა #3ა", "რუსთაველის ქუჩა №12", "ბაზარი №2", "№5 სკოლა", "No such", "", None]
    found = names.looked_up(spark.createDataFrame([(k, n, "old") for k, n in enumerate(asked)], "id int, name string, src string"), "name", known).orderBy("id").collect()
    assert [(r.ru, r.en) for r in found] == [
        ("Улица Руставели", "Rustaveli Street"), ("Улица Руставели №3а", "Rustaveli Street №3a"), ("Улица Руставели №12", "Rustaveli Street №12"), ("Рынок 2", None), (None, "School 5"), (None, None), (None, None), (None, None),
    ]


def test_reads_have_their_shapes(spark):
    legs = spark.createDataFrame([(1, 1, 0, 7, 1.0, 2.0), (1, 1, 1, 8, 1.5, 2.0), (2, 1, 0, 7, 1.0, 2.0)], "route_id int, direction int, seq int, stop_id int, lat double, lon double")
    board = spark.createDataFrame([(7, 1, 1, 5, 3, 2, 1)], "stop_id int, route_id int, direction int, plate int, scheduled int, live int, place int")
    patterns = spark.createDataFrame([(1, 1, [0, 5], [480])], "route_id int, direction int, offsets array<int>, departures array<int>")
    network = reads.Reads(legs, board, patterns, spark.createDataFrame([(5, 1, 1.0, 2.0), (6, 2, 1.0, 2.0)], "plate int, route_id int, lat double, lon double"))
    assert [tuple(r) for r in network.stop(7).orderBy("route_id").collect()] == [(7, 1.0, 2.0, 1, 1, 0), (7, 1.0, 2.0, 2, 1, 0)]
    assert network.arrivals(7).count() == 1 and network.arrivals(8).count() == 0 and network.vehicles([2]).first().plate == 6 and network.vehicles().count() == 2
    assert dict(network.timetable().dtypes)["offsets"] == "array<bigint>" and network.routes().where("route_id = 1").first().n_stops == 2
    with pytest.raises(Exception, match="plate"):
        reads.Reads(legs, board.drop("plate"), patterns, legs).arrivals(7)
    assert network.stops().select(F.count("*")).first()[0] == 2
