"""Order statistics, map elements and missed polls, against plain Python."""

import json
import random

from wayline.operators import order
from wayline.sources import elements
from wayline.streaming import run, state


def test_upper_median_is_exact(spark):
    rng = random.Random(6)
    groups = {
        "few": [1.0, 2.0, 3.0, 10.0], "one": [5.0], "ties": [7.0] * 900 + [rng.random() for _ in range(400)], "spread": [rng.expovariate(0.001) for _ in range(5001)],
        "same": [2.5] * 1000, "two": [0.0] * 500 + [1.0] * 500, "odd": [-float(k) for k in range(777)],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("null", None), ("few", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    for accuracy in (20, 100, 2000):
        found = {r.g: r.middle for r in order.upper_median(df, ["g"], "v", accuracy=accuracy).collect()}
        assert found == {g: sorted(v)[len(v) // 2] for g, v in groups.items()}
    every = sorted(v for values in groups.values() for v in values)
    assert [tuple(r) for r in order.upper_median(df, [], "v", "m").collect()] == [(every[len(every) // 2],)]
    assert order.upper_median(df.where("false"), [], "v").count() == 0 and order.upper_median(df.where("g = 'null'"), ["g"], "v").count() == 0
    plan = order.upper_median(df, ["g"], "v")._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "sort_array" not in plan


def test_elements_are_resolved_in_order(spark, tmp_path):
    node = lambda k, **more: {"type": "node", "id": k, "lat": k / 10, "lon": -k / 10, **more}
    first = {"elements": [node(1), node(2), node(3, tags={"name": "x"}), {"type": "way", "id": 9, "nodes": [3, 1, 99, 2, 3]}, {"type": "node", "id": 50}]}
    second = {"elements": [
        node(2), {"type": "way", "id": 8, "geometry": [{"lat": 5.0, "lon": 5.0}, None, {"lat": 6.0, "lon": 5.0}, {"lat": 6.0, "lon": 6.0}], "center": {"lat": 5.5, "lon": 5.5}},
        {"type": "relation", "id": 4, "members": [
            {"type": "node", "ref": 1, "role": "admin_centre"}, {"type": "node", "ref": 2, "role": "admin_centre"}, {"type": "way", "ref": 9, "role": "outer"}, {"type": "way", "ref": 8, "role": "inner"},
            {"type": "way", "ref": 9, "role": "subarea"}, {"type": "way", "ref": 77, "role": "outer", "geometry": [{"lat": 1.0, "lon": 1.0}, {"lat": 2.0, "lon": 1.0}]}, {"type": "way", "ref": 123, "role": "outer"}]},
        {"type": "relation", "id": 5, "members": [{"type": "node", "ref": 3, "role": "label"}, {"type": "node", "ref": 7, "role": "label", "lat": 7.0, "lon": 7.5}, {"type": "node", "ref": 1, "role": "label", "lat": None}]},
        {"type": "relation", "id": 6},
    ]}
    (tmp_path / "a.json").write_text(json.dumps(first) + "\n" + json.dumps(second) + "\n" + json.dumps({"remark": "empty"}))
    found = elements.read_elements(spark, f"file://{tmp_path}/a.json")
    vertices = sorted(tuple(r) for r in elements.way_vertices(found).collect())
    assert vertices == [(8, 0, 5.0, 5.0), (8, 2, 6.0, 5.0), (8, 3, 6.0, 6.0), (9, 0, 0.3, -0.3), (9, 1, 0.1, -0.1), (9, 3, 0.2, -0.2), (9, 4, 0.3, -0.3)]
    edges = sorted(tuple(r) for r in elements.area_edges(found).select("area_id", "member", "i", "a_lat", "b_lat").collect())
    assert edges == [(4, 2, 1, 0.3, 0.1), (4, 2, 4, 0.2, 0.3), (4, 3, 3, 6.0, 6.0), (4, 5, 1, 1.0, 2.0)]
    assert sorted(tuple(r) for r in elements.area_labels(found).collect()) == [(4, "admin_centre", 0.1, -0.1), (5, "label", 0.1, -0.1)]
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "b.json").write_text(json.dumps(first, indent=1))
    whole = elements.read_elements(spark, f"file://{tmp_path}/whole", whole_files=True)
    assert [(r.type, r.id) for r in elements.places(whole, 0.0, -0.25, 1.0, 0.0).orderBy("id").collect()] == [("node", 1), ("node", 2)]


def test_silence_is_told_whatever_the_batches(spark, tmp_path):
    rng = random.Random(9)
    rows, now = [], 0
    for k in range(240):
        now += rng.choice([1, 2, 5, 40]) * 60_000
        rows.append((k, k % 5 if k < 200 else 0, now, rng.random() < 0.4))
    df = spark.createDataFrame(rows, "event_id bigint, line bigint, now_ms bigint, ok boolean")
    silent = 100 * 60_000
    want = []
    for line in range(5):
        own = [r for r in rows if r[1] == line]
        failed, last = 0, None
        for event, _, at, ok in own:
            if last is not None and at - last > silent:
                want.append((line, None, last + silent, failed, True))
                failed = 0
            failed, last = 0 if ok else failed + 1, at
            want.append((line, event, at, failed, failed >= 3))
        if last + silent < rows[-1][2] + 1 - 600_000:
            want.append((line, None, last + silent, failed, True))
    assert sum(w[1] is None for w in want) > 5
    for cuts in ((0, 240), (0, 60, 61, 150, 240)):
        at = f"{tmp_path}/{len(cuts)}"
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            df.where(f"event_id >= {a} and event_id < {b}").coalesce(1).write.parquet(f"{at}/polls.parquet/{k}")
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{at}/polls.parquet")
        found = run.appended(state.missed_polls(stream, "line", silent)).collect()
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
