"""Every query of the library with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from glimmer.jobs import registry
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def normal(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else float(f"{v:.10g}") + 0.0 if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert sorted((normal(r[c] for c in names) for r in df.collect()), key=repr) == sorted((normal(r[k] for k in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
