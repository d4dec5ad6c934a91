"""Named queries over the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def rounded_sql(sql: str, **digits: int) -> str:
    """``sql`` with columns rounded, as ``rounded`` does on the Spark side."""
    parts = ", ".join(f"round({c}, {d}) AS {c}" for c, d in digits.items())
    return f"SELECT * REPLACE ({parts}) FROM ({sql}) AS t"


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    from pyspark.sql import functions as F
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])
