"""Daily search-intent metrics: one file per year directory, overlapping at the edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygauge.functions.scalars import day_of, number
from daygauge.sources.columns import named, read_wanted
from daygauge.sources.headers import header_index


def keep_first(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order, as an aggregation (a repeated key is reduced before the shuffle)."""
    others = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return picked.select(*key, *[F.col(f"_r.{c}").alias(c) for c in others])


def read_intent_days(spark: SparkSession, path, candidates: Sequence[str], *, date: str = "date", out: str = "intent") -> DataFrame:
    """(date, intent): the date column by name or else the first one, the first candidate column any file has.

    Files are taken in path order and the first row of a date wins. Choosing the column reads the headers only.
    """
    heads = header_index(spark, path)
    names = {r[0] for r in heads.select(F.explode("header").alias("name")).where(F.col("name").isin(list(candidates))).distinct().collect()}
    column = next((c for c in candidates if c in names), None)
    if column is None:
        raise ValueError(f"no intent column among {list(candidates)}")
    rows = read_wanted(spark, path, {"by_name": named(date), "first": 0, "value": named(column)}, heads=heads)
    day = day_of(F.when(F.col("has_by_name"), F.col("by_name")).otherwise(F.col("first")))
    days = rows.select(day.alias("date"), number("value").alias(out), "_file", "_at").where("date is not null")
    return keep_first(days, ["date"], ["_file", "_at"]).select("date", out)
