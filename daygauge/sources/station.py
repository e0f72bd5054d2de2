"""Station exports (Japanese code page, three header lines) and scraped hourly tables, as Spark jobs over many files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daygauge.functions.scalars import clean_cell, file_stem, hour_ending, number
from daygauge.sources.headers import header_index, scan_by_header

# Column labels of the export format.
TIMESTAMP_LABEL = "年月日時"
EXPORT_LABELS = {"snow_depth_cm": "積雪(cm)", "snowfall_1h_cm": "降雪(cm)", "temp_c": "気温(℃)", "precip_1h_mm": "降水量(mm)",
                 "sun_1h_h": "日照時間(時間)", "weather_type": "天気", "humidity_pct": "相対湿度(％)"}
WIND_LABEL, WIND_DIRECTION_LABEL = "風速(m/s)", "風向"
STATION_COLUMNS = ("timestamp", "snow_depth_cm", "snowfall_1h_cm", "temp_c", "precip_1h_mm", "sun_1h_h", "wind_speed_ms",
                   "weather_type", "humidity_pct")


def _moment(cell: Column) -> Column:
    """Timestamps like 2024/1/2 3:00:00, with or without seconds, or in ISO form."""
    text = F.trim(cell)
    return F.coalesce(F.try_to_timestamp(text, F.lit("y/M/d H:mm:ss")), F.try_to_timestamp(text, F.lit("y/M/d H:mm")),
                      F.try_to_timestamp(text)).cast("timestamp_ntz")


def _blank(cell: Column) -> Column:
    return F.coalesce(F.trim(cell), F.lit("")) == ""


def _position(label: Column, wanted: str, *tests) -> Column:
    """First position whose label matches and which passes the tests on (position)."""
    def mark(h: Column, i: Column) -> Column:
        ok = F.coalesce(F.trim(h) == wanted, F.lit(False))
        for t in tests:
            ok = ok & t(i)
        return F.when(ok, i)

    return F.array_min(F.filter(F.transform(label, mark), lambda i: i.isNotNull()))


def station_positions() -> dict[str, Column]:
    """Column positions from the label, sub-header and quality lines, the last three records of a ``header_index``.

    Each label occurs several times; its value column is the one without a quality note. Wind speed and direction share a label
    and differ in the sub-header.
    """
    label, sub, quality = (F.element_at("records", i) for i in (-3, -2, -1))

    def value(i: Column) -> Column:
        return _blank(F.get(quality, i))

    def direction(i: Column) -> Column:
        return F.coalesce(F.trim(F.get(sub, i)) == WIND_DIRECTION_LABEL, F.lit(False))

    wind = F.coalesce(_position(label, WIND_LABEL, value, lambda i: ~direction(i)), _position(label, WIND_LABEL, value))
    return {"moment": F.lit(0), "wind_speed_ms": wind} | {name: _position(label, text, value) for name, text in EXPORT_LABELS.items()}


def read_station_exports(spark: SparkSession, path, *, encoding: str = "CP932") -> DataFrame:
    """Typed hourly rows of export files of any number and size with the name of their file; unreadable cells are NULL.

    A file without the label line or without one of the value columns gives no row. The header index finds the label line and the
    two behind it; header lines carry no timestamp. Files are decoded by the CSV reader (needs ``spark.sql.legacy.javaCharsets``).
    """
    if encoding.upper() not in ("UTF-8", "UTF8"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    heads = header_index(spark, path, encoding=encoding, stop=TIMESTAMP_LABEL, after=2)
    positions = station_positions()
    parts = scan_by_header(spark, heads, positions, encoding=encoding, needed=list(positions), width=F.size(F.element_at("records", -3)))
    typed = [number(F.trim(F.col(c))).alias(c) if c != "weather_type" else F.nullif(F.trim(F.col(c)), F.lit("")).alias(c)
             for c in STATION_COLUMNS if c != "timestamp"]
    return parts.select(_moment(F.col("moment")).alias("timestamp"), *typed,
                        F.concat(file_stem("_file"), F.lit(".csv")).alias("source_file")).where("timestamp is not null")


def scraped_hours(rows: DataFrame, *, day: str = "date", hour: str = "hour", cells: Mapping[str, str] | None = None) -> DataFrame:
    """Stored scraped rows cleaned: markers and quality brackets off, rows without a numeric hour dropped, hour 24 is the
    next midnight."""
    names = dict(cells or {c: c for c in rows.columns if c not in (day, hour)})
    clock = clean_cell(hour)
    kept = rows.where(clock.rlike(r"^\d+$"))
    return kept.select(hour_ending(day, clock.try_cast("int")).alias("timestamp"),
                       *[clean_cell(source).alias(out) for source, out in names.items()])
