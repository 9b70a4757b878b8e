"""Every query of the catalogue against its DuckDB SQL on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from gleanery import plans


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    return v.isoformat()[:19] if isinstance(v, (datetime.datetime, datetime.date)) else v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, tables, name):
    df = plans.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in plans.ORACLES:
        assert rows
        return
    out = tables.sql(plans.ORACLES[name])
    assert sorted(out.columns) == cols
    at = [out.columns.index(c) for c in cols]
    assert rows == sorted(repr([plain(r[k]) for k in at]) for r in out.fetchall())
