"""The driver's contract, and each query against its SQL at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = entry.oracle_sql()
#: Long plans or streams, one after the other in other tests or slow to start; the rest is compared here.
SLOW = {"j12_one_change", "j12_one_change_nations"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_gives_the_board(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n not in SLOW and not n.startswith("op")))
def test_query_matches_its_sql(spark, con, name):
    found = entry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    rows = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str) == rows
