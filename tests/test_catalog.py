"""Every registered query with SQL, row for row against DuckDB on the smallest tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from siltstone.plans import catalog


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, small, db, name):
    got = catalog.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    found = db.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows_only(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__

    assert {"query_id", "key", "score", "rank"} == set(catalog.flagship(spark, small).columns)
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
