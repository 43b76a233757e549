"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from loamgraph import registry


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf, duck):
    df = registry.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in registry.ORACLES:
        return
    got = duck.sql(registry.ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(got.columns)
    at = [got.columns.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in names) for r in rows), key=repr) == want
