"""Every query against its SQL, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from tidemark.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 7) + 0.0)
    if isinstance(value, datetime.datetime) and value.time() == datetime.time(0):
        return str(value.date())
    return str(value)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.sql(sql)
    order = [found.columns.index(c) for c in columns]
    assert sorted(found.columns) == columns
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())
