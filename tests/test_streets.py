"""Streets of houses, against the walk from house to house."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayline.operators import resolve, streets


def metres(a, b):
    return round(math.hypot((b[1] - a[1]) * 111_320 * math.cos(math.radians((a[0] + b[0]) / 2)), (b[0] - a[0]) * 111_320), 3)


def walk(houses, roads):
    """(street, how) of each house in order; roads: id, name, points. Only exact names, and «x» before a name as another spelling."""
    grown, out = {}, {}
    for h, name, *at in houses:
        near = [(metres(at, p), s) for s, n, points in roads if n == name for p in points]
        drawn = min((x for x in near if x[0] < 1500), default=None)
        new = min(((metres(at, p), s) for s, points in grown.get(name, {}).items() for p in points), key=lambda x: (x[0], -x[1]), default=None)
        if new and new[0] < 1500 and (drawn is None or new[0] < drawn[0]):
            out[h] = new[1], "joined"
            grown[name][new[1]].append(at)
            continue
        if drawn:
            out[h] = drawn[1], "exact"
            continue
        like = min(((metres(at, p), s) for s, n, points in roads if n.split()[-1] == name.split()[-1] for p in points if metres(at, p) < 400), default=None)
        if like:
            out[h] = like[1], "respelled"
            continue
        out[h] = -1 - h, "new"
        grown.setdefault(name, {})[-1 - h] = [at]
    return out


@pytest.mark.parametrize("wide", [0.01, 0.06])
def test_streets_grow_as_if_house_by_house(spark, wide):
    rng = random.Random(8)
    spot = lambda: (round(41.6 + rng.random() * wide, 3), round(41.6 + rng.random() * wide, 3))  # noqa: E731  many at one place
    names = ["alpha", "beta", "gamma", "old alpha", "old delta"]
    houses = [(k, rng.choice(names), *spot()) for k in range(400)]
    roads = [(s, rng.choice(names[:4]), [spot() for _ in range(2)]) for s in range(6)]
    left = spark.createDataFrame([(*h, 1) for h in houses], "house_id bigint, name string, lat double, lon double, street_id int").repartition(3)
    right = spark.createDataFrame([(s, n, None, None, *p) for s, n, points in roads for p in points], "street_id bigint, s_name string, s_ru string, s_en string, r_lat double, r_lon double")
    found = {r.house_id: (r.street_id, r.how) for r in streets.streets_of(left, right).collect()}
    assert found == walk(houses, roads)
    assert streets.streets_of(left.where("house_id < 0"), right).count() == 0
    alone = streets.streets_of(left, right.where("street_id < 0"))
    assert {r.house_id: (r.street_id, r.how) for r in alone.collect()} == walk(houses, [])


def test_keys_of_spellings(spark):
    pairs = [
        ("შარაშიძე მიხეილის ქუჩა", "მიხეილ შარაშიძის ქუჩა", True), ("ნინოს მე-3 შეს", "ნინოს III შესახვევი", True), ("ადლიის", "ადლიას", True), ("ნინოს მე-3 შეს", "ნინოს IV შესახვევი", False),
        ("რუსთაველის ჩიხი", "რუსთაველის ქუჩა", False), ("რუსთაველის", "რუსთაველის გამზირი", True), ("რუსთაველის", "რუსთაველის ჩიხი", False), ("", "რუსთაველის", False),
        ("წმ. ნინოს ქ.", "წმინდა ნინო", True), ("26 მაისის ქუჩა", "მაისის ქუჩა", False),
    ]
    rows = spark.createDataFrame(pairs, "a string, b string, same boolean")
    found = rows.select("a", "b", "same", streets.same_street(streets.street_key(F.col("a")), streets.street_key(F.col("b"))).alias("found")).collect()
    assert [(r.a, r.b, r.found) for r in found] == pairs
    words = spark.createDataFrame([("Zurab Gorgiladze Street", "Gorgiladze St", True), ("7 May Street", "May Street", False), ("Улица Пушкина", "ул. Пушкина", True), ("Street", "Avenue", False)], "a string, b string, same boolean")
    assert all(r.same == r.found for r in words.select("same", streets.same_words(F.col("a"), F.col("b")).alias("found")).collect())


def test_kinds_of_names_by_their_alias(spark):
    rows = resolve.with_keys(spark.createDataFrame([("Rustaveli ave",), ("რუსთაველის გამზირი",), ("Pushkin st",), ("ნინოს ქ.",), ("ნინოს მოედან",), ("ნინო",)], "name string"), "name")
    assert [r.type for r in rows.collect()] == ["გამზირი", "გამზირი", "ქუჩა", "ქუჩა", "მოედან", None]
