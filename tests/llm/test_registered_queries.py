"""Registered queries that have an SQL equivalent give the same rows as DuckDB."""

import duckdb
import pytest

from leafmill.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, sf_dir).select(*want.columns)
    key = lambda r: tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.fetchall()))
