"""Every query against its SQL, run by DuckDB over the same tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from pathloom import queries

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
BUILDS, CHECKS = queries.load(), queries.checks()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(BUILDS))
def test_query(name, spark, duck):
    df = BUILDS[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in CHECKS:
        return
    found = duck.sql(CHECKS[name])
    names = found.columns
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(_plain(row[k]) for k in order) for row in found.fetchall()), key=repr)
    assert got == want
