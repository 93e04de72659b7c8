"""Feeds, their failures, and snapshots."""

import io
import json
import urllib.error

import pytest

from wayline.sources import feed, live


def test_a_line_a_partition(spark, tmp_path):
    buses = {"7": [{"Name": " AB-1 ", "Lat": 41.6, "Lon": 41.5, "Status": 1}, {"Name": "", "Lat": 41.7, "Lon": 41.5, "Status": -1}], "8": None}
    for route, data in buses.items():
        (tmp_path / f"{route}.json").write_text(json.dumps({"data": data}))
    df = live.positions(spark, f"file://{tmp_path}/{{route}}.json", ["7", "8"])
    assert df.rdd.getNumPartitions() == 2
    assert sorted((r.route_id, r.plate, r.status) for r in df.collect()) == [("7", "7:41.7,41.5", -1), ("7", "AB-1", 1)]


def test_fetch_tries_again_but_not_when_refused():
    calls = []

    def opened(code):
        def run(url, timeout):
            calls.append(url)
            if len(calls) < 2:
                raise urllib.error.HTTPError(url, code, "", None, None)
            return io.StringIO('{"a": 1}')

        return run

    assert live.fetch("x", pause=0, opened=opened(503)) == {"a": 1} and len(calls) == 2
    calls.clear()
    with pytest.raises(live.FeedError) as e:
        live.fetch("x", pause=0, opened=opened(404))
    assert e.value.status == 404 and len(calls) == 1


def test_snapshots_outlive_failures(spark, tmp_path):
    made = []

    def make(ok=True):
        made.append(ok)
        if not ok:
            raise live.FeedError("x", 502)
        return spark.range(len(made))

    store = live.Snapshots(spark, f"file://{tmp_path}/s", ttl_s=4)
    with pytest.raises(live.FeedError):
        store.load(lambda: make(False), 0)
    assert store.load(make, 10).count() == 2 and store.load(make, 12).count() == 2 and len(made) == 2
    assert store.load(lambda: make(False), 20).count() == 2 and store.load(lambda: make(False), 21).count() == 2 and len(made) == 3
    assert store.load(make, 30).count() == 4


def test_nested_document(spark, tmp_path):
    stop = {"id": "s", "BusStopNumber": 5, "nameKA": "ქ", "nameEN": "q", "lat": 1.0, "lon": 2.0, "routes": {"r": {"Status": 2, "Order": 3, "times": ["09:00", "08:00"]}, "gone": {"Status": 1, "Order": 1, "times": []}}}
    doc = {"data": {"busStops": {"s": stop}, "routesNames": {"r": {"id": "r", "nameKA": "a", "nameEN": "b", "RouteIsCircle": False, "RouteSortOrder": 1}}, "routeCoordinatesGrouped": {"r": [{"lat": 1.0, "lng": 2.0}]}}}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    data = feed.read_dataset(spark, f"{tmp_path}/d.json")
    assert [tuple(r) for r in feed.stop_routes(data).collect()] == [("s", "r", 2, 3, ["08:00", "09:00"])]
    assert feed.stops(data).count() == feed.routes(data).count() == feed.shape_points(data).count() == 1
