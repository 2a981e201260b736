"""Every query with SQL against DuckDB at the smallest scale; the others give rows."""

import decimal
import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_small):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_small}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def rows_of(names, rows):
    return Counter(repr([plain(v) for _, v in sorted(zip(names, r, strict=True))]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
