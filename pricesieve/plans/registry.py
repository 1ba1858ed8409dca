"""Registry of named queries: Spark callable plus the DuckDB oracle text."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pricesieve.plans.fixtures import with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SQL: dict[str, str] = {}  # oracle texts without their fixtures, for composed oracles


def _widen(df: DataFrame) -> DataFrame:
    """Report integers as BIGINT and floats as DOUBLE, as the oracle does."""
    cols = []
    for f in df.schema.fields:
        c = df[f"`{f.name}`"]
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(key: str, fixtures=(), sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key``; ``sql`` is the oracle
    (DuckDB) reading the stored tables and the named fixtures."""

    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, sf_dir: _widen(fn(spark, sf_dir))
        if sql is not None:
            SQL[key] = sql
            ORACLE[key] = with_fixtures(fixtures, sql)
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from pricesieve.plans import (  # noqa: F401
        q_answers, q_booking, q_dedup, q_fuel, q_links, q_products, q_sources, q_text, q_textprep, q_verify,
    )
