"""Queries against their SQL on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from ripplefold.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(tiny_dir):
    c = duckdb.connect()
    for path in glob.glob(f"{tiny_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return c


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, tiny_dir, name):
    df = QUERIES[name](spark, tiny_dir)
    columns = sorted(df.columns)
    told = duck.execute(SQL[name])
    names = [x[0] for x in told.description]
    assert sorted(names) == columns
    truth = sorted(repr([plain(row[names.index(c)]) for c in columns]) for row in told.fetchall())
    assert sorted(repr([plain(row[c]) for c in columns]) for row in df.collect()) == truth


def test_flagship_and_names(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
