"""Visitor surveys: files whose columns differ from year to year."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygauge.functions.scalars import day_of, first_number, mapped, number, text_or_empty
from daygauge.sources.columns import find_column, holding, named, read_wanted
from daygauge.sources.weather import first_readable


def survey_dates(spark: SparkSession, path) -> DataFrame:
    """(prefecture, date) from the first two columns of every file, bad dates dropped."""
    rows = read_wanted(spark, path, {"prefecture": 0, "day": 1}, multiline=True)
    return rows.select("prefecture", day_of("day").alias("date")).where("date is not null")


def survey_satisfaction(spark: SparkSession, path, names: Mapping[str, str]) -> DataFrame:
    """Ratings, location and texts by exact column name; absent columns become NULL or empty text.

    ``names`` maps satisfaction, satisfaction_service, nps, location, reason, inconvenience and freetext to headers.
    """
    roles = ("satisfaction", "satisfaction_service", "nps", "location", "reason", "inconvenience", "freetext")
    wanted: dict[str, object] = {"prefecture": 0, "day": 1}
    wanted |= {r: named(names[r]) for r in roles if r in names}
    return answers(read_wanted(spark, path, wanted, multiline=True).withColumn("date", day_of("day")))


def answers(rows: DataFrame) -> DataFrame:
    """The fixed shape of the satisfaction table from rows that may lack any optional column."""
    def col(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    return rows.select(
        "prefecture", "date", number(col("satisfaction")).alias("satisfaction"),
        number(col("satisfaction_service")).alias("satisfaction_service"), first_number(col("nps")).alias("nps_raw"),
        text_or_empty(col("location")).alias("location"),
        *[text_or_empty(col(c)).alias(c) for c in ("reason", "inconvenience", "freetext")]).where("date is not null")


def survey_texts(spark: SparkSession, path, *, satisfaction: str, reason: str, not_reason: str, inconvenience: str,
                 freetext: str) -> DataFrame:
    """Free texts with columns found by part of their name; the reason column must not be that of the service. Bad dates are dropped."""
    rows = read_wanted(spark, path, {
        "prefecture": 0, "day": 1, "satisfaction": holding(satisfaction), "reason": holding(reason, without=[not_reason]),
        "inconvenience": holding(inconvenience), "freetext": holding(freetext)}, multiline=True)
    texts = [text_or_empty(c).alias(c) for c in ("reason", "inconvenience", "freetext")]
    return (rows.select("prefecture", day_of("day").alias("date"), number("satisfaction").alias("satisfaction"), *texts)
            .where("date is not null"))


def raw_survey(spark: SparkSession, path: str, *, date: str, spending: str, midpoints: Mapping[str, float]) -> DataFrame:
    """Every column plus the day and the midpoint of the spending category; a missing file gives an empty table."""
    rows = first_readable(spark, path, multiline=True)
    if rows is None:
        return spark.createDataFrame([], T.StructType.fromDDL("date date, spending_midpoint double"))
    return with_midpoint(rows, date=date, spending=spending, midpoints=midpoints)


def with_midpoint(rows: DataFrame, *, date: str, spending: str, midpoints: Mapping[str, float]) -> DataFrame:
    out = rows
    if find_column(rows.columns, names=[spending]):
        out = out.withColumn("spending_midpoint", mapped(spending, midpoints))
    if find_column(rows.columns, names=[date]):
        out = out.withColumn("date", day_of(date))
    return out
