"""Every registered query with an SQL equivalent gives the same rows as DuckDB on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
from leafmill.plans import all as plans  # noqa: E402


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in BASE:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_runs_without_sql(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0
