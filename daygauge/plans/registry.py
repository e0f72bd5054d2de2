"""Named queries, each next to the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """Doubles to a fixed number of decimals (minus zero as zero), as the SQL side does."""
    return df.withColumns({c: F.round(c, d) + F.lit(0.0) for c, d in digits.items()})


def query(name: str, sql: str | None = None, digits: Mapping[str, int] | None = None):
    """Register a query. ``digits`` lists the double columns both sides round before they are compared."""
    digits = dict(digits or {})

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = (lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)) if digits else fn
        if sql is not None:
            inner = sql.strip()
            if digits:
                columns = ", ".join(f"round({c}, {d}) + 0.0 AS {c}" for c, d in digits.items())
                inner = f"SELECT * REPLACE ({columns}) FROM (\n{inner}\n)"
            ORACLES[name] = inner
        return fn

    return register


def r6(*columns: str) -> dict[str, int]:
    return dict.fromkeys(columns, 6)
