"""Every query with SQL gives the rows that DuckDB gives for it."""

from __future__ import annotations

import datetime
import math

import pytest

from pitwise import registry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 4) + 0.0)
    if isinstance(v, datetime.datetime) and v.time() == datetime.time():
        return v.date().isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, views, name):
    made, asked = registry.queries()[name](spark, SF), views.sql(registry.oracle_sql()[name])
    names = sorted(made.columns)
    assert names == sorted(asked.columns)
    ours = sorted(tuple(plain(r[c]) for c in names) for r in made.collect())
    theirs = sorted(tuple(plain(r[asked.columns.index(c)]) for c in names) for r in asked.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0
