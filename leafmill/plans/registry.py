"""Registered queries: each applies one operator to the given tables or to plain projections of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.plans.tables import Tables, sql_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Registers a function of ``Tables`` under ``name``; ``sql`` follows on the derived tables named in ``uses``."""

    def keep(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql_tables(uses.split(), sql)
        return build

    return keep
