"""Hourly weather files to typed hours and to days."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygauge.functions.scalars import number
from daygauge.operators.daily import daily_measures, keys
from daygauge.sources.columns import read_named, rename_missing

# Field names of the hourly format and their short names.
HOURLY_FIELDS = {"temp_c": "temp", "precip_1h_mm": "precip", "sun_1h_h": "sun", "wind_speed_ms": "wind",
                 "snow_depth_cm": "snow_depth", "humidity_pct": "humidity"}
NODE_FIELDS = ("temp", "precip", "wind", "snow_depth")


def first_readable(spark: SparkSession, *paths: str, multiline: bool = False) -> DataFrame | None:
    """The first of the paths that exists, read as text columns; ``multiline`` allows line breaks within quotes."""
    for path in paths:
        try:
            return read_named(spark, path, multiline=multiline)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return None


def typed_hours(rows: DataFrame, *, timestamp: str = "timestamp", series=None, fields: dict[str, str] | None = None) -> DataFrame:
    """Known fields renamed and coerced to numbers, day truncated from the timestamp; unreadable cells are NULL."""
    out = rename_missing(rows, fields or HOURLY_FIELDS)
    measures = [c for c in (fields or HOURLY_FIELDS).values() if c in out.columns]
    ts = F.try_to_timestamp(F.col(timestamp).cast("string")).cast("timestamp_ntz")
    return out.select(*keys(series), ts.alias("timestamp"), F.to_date(ts).alias("date"), *[number(c).alias(c) for c in measures])


def weather_days(hours: DataFrame, *, series=None) -> DataFrame:
    """Precipitation summed, everything else averaged; fields that are absent stay absent."""
    means = {c: c for c in HOURLY_FIELDS.values() if c != "precip"}
    return daily_measures(hours.where("date is not null"), series=series, sums={"precip": "precip"}, means=means)


def read_weather_days(spark: SparkSession, *paths: str) -> DataFrame:
    """Days from the primary path, else from the fallback paths, else an error."""
    rows = first_readable(spark, *paths)
    if rows is None:
        raise FileNotFoundError(f"no weather file under {paths}")
    return weather_days(typed_hours(rows))


def read_site_weather(spark: SparkSession, paths: dict[str, str], *, site: str = "site") -> DataFrame:
    """Days of several stations in one table; a station without files contributes no row."""
    out = spark.createDataFrame([], T.StructType.fromDDL(
        f"{site} string, date date, temp double, precip double, wind double, snow_depth double"))
    for name, path in paths.items():
        rows = first_readable(spark, path)
        if rows is None:
            continue
        days = weather_days(typed_hours(rows)).withColumn(site, F.lit(name))
        have = [c for c in NODE_FIELDS if c in days.columns]
        out = out.unionByName(days.select(site, "date", *have), allowMissingColumns=True)
    return out
