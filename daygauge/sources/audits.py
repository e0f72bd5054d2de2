"""Audits that take paths: what the readers return next to what the files hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daygauge.functions.scalars import number
from daygauge.operators import quality as ql
from daygauge.session import at_once, durable, landed
from daygauge.sources.columns import file_audit, holding, named, read_wanted
from daygauge.sources.counters import counter_days, counter_files
from daygauge.sources.headers import header_index


def _series(file: str, pattern: str | None) -> Column:
    return F.regexp_extract(file, pattern, 1) if pattern else F.lit(None).cast("string")


def counter_files_report(spark: SparkSession, path, *, name: str = "counter", date_pattern: str | None = None,
                         series_pattern: str | None = None, law: str = "auto") -> DataFrame:
    """Report of a folder of counter files; with ``series_pattern`` (first group in a file's path) one per counter, all by the same jobs.

    A folder without a file is a report that says so, a path that does not exist too; with ``series_pattern`` it has no report.
    """
    by = "series" if series_pattern else None
    heads = header_index(spark, path)
    read = counter_files(spark, path, date_pattern=date_pattern, series_pattern=series_pattern, heads=heads)
    days = counter_days(read, drop_zero=False, by_series=bool(by))
    files = file_audit(spark, path, ql.COUNTER_COLUMNS, heads=heads)
    if by:
        files = files.withColumn(by, _series("file", series_pattern))
    return ql.counter_report(durable(days), name=name, files=files, series=by, law=law)


def station_hours(spark: SparkSession, path, station_pattern: str | None = None, heads: DataFrame | None = None) -> DataFrame:
    """(station, timestamp, measures) of hourly files of any stations and headers by one index; the station stands in the path.

    Cells that cannot be read and columns that a file lacks are NULL.
    """
    rows = read_wanted(spark, path, {c: named(c) for c in ("timestamp", *ql.WEATHER_COLUMNS)}, heads=heads)
    ts = F.try_to_timestamp("timestamp").cast("timestamp_ntz")
    return rows.select(_series("_file", station_pattern).alias("station"), ts.alias("timestamp"), *[number(c).alias(c) for c in ql.WEATHER_COLUMNS])


def weather_files_report(spark: SparkSession, path, *, name: str = "weather", station_pattern: str | None = None,
                         stations: Sequence[str] | None = None, law: str = "auto") -> DataFrame:
    """Report of hourly weather files; with ``station_pattern`` one per station of the files and per expected one of ``stations``.

    All stations go through the same jobs. Columns count by the headers of a station's own files. No file, an unreadable
    or damaged file and negative precipitation are errors; columns that are absent, gaps and implausible values are warnings.
    """
    heads = header_index(spark, path)
    files = file_audit(spark, path, ("timestamp", *sorted(ql.WEATHER_COLUMNS)), heads=heads)
    rows = landed(station_hours(spark, path, station_pattern, heads))
    if station_pattern is None:
        return ql.weather_report(rows.drop("station"), name=name, files=files, law=law)
    files = files.withColumn("station", _series("file", station_pattern))
    return ql.weather_report(rows, name=name, series="station", stations=stations, files=files, law=law)


def survey_files_report(spark: SparkSession, path, *, satisfaction: str, expected: Sequence[str], name: str = "survey") -> DataFrame:
    """Report of survey files with any headers: the region is the first column, the rating the first that holds ``satisfaction``.

    ``expected`` are parts of names of which some file must have each. Files that cannot be read are warnings as long as one can.
    """
    heads = header_index(spark, path)
    rows = read_wanted(spark, path, {"region": 0, "satisfaction": holding(satisfaction)}, multiline=True, heads=heads)
    files = file_audit(spark, path, multiline=True, heads=heads)
    return ql.survey_report(durable(rows.select("region", "satisfaction")), satisfaction="satisfaction", region="region", expected=expected,
                            name=name, files=files)


REPORTS = {"counter": counter_files_report, "weather": weather_files_report, "survey": survey_files_report}


def audit_files(spark: SparkSession, sources: Mapping[str, tuple[str, Mapping]]) -> dict[str, DataFrame]:
    """The report of every named source: ``sources`` maps a name to its kind (counter, weather or survey) and to the arguments of
    that kind's report, the path among them. ``quality.audit_totals`` sums them up, ``sinks.write_report`` writes one."""
    steps = [partial(REPORTS[kind], spark, name=name, **arguments) for name, (kind, arguments) in sources.items()]
    return dict(zip(sources, at_once(steps), strict=True))
