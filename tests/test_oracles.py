"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from srcloom.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr(tuple(round(v[k], 6) if isinstance(v[k], float) else v[k] for k in order)) for v in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, got.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
