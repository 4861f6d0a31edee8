"""Every registered query of the library gives the rows of its SQL on the smallest data."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from spatialis.plans import registry
from tests.conftest import SF

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return int(v) if v.is_integer() else v
    return v


def rows(names, data):
    return sorted((tuple(plain(v) for _, v in sorted(zip(names, r))) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    want = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
