"""People-counter files: one CSV per counter and day, the day in the file name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygauge.functions.scalars import day_of, file_stem, number
from daygauge.operators.daily import daily_sum
from daygauge.sources.columns import named, read_named, read_wanted


def counter_files(spark: SparkSession, path, *, mixed_headers: bool = True, date_pattern: str | None = None,
                  series_pattern: str | None = None, heads: DataFrame | None = None) -> DataFrame:
    """(file, stem, series, count): the total count of every file that has the two counter columns.

    The date is the file stem, or the first group of ``date_pattern`` in the path. Other files are passed over.
    """
    if mixed_headers:
        rows = read_wanted(spark, path, {"start": named("aggregate from"), "total": named("total count")}, needed=["start", "total"],
                           heads=heads)
    else:
        rows = read_named(spark, path).withColumnRenamed("total count", "total")
    sums = rows.groupBy(F.col("_file").alias("file")).agg(F.coalesce(F.sum(number("total")), F.lit(0.0)).cast("long").alias("count"))
    stem = F.regexp_extract("file", date_pattern, 1) if date_pattern else file_stem("file")
    series = F.regexp_extract("file", series_pattern, 1) if series_pattern else F.lit(None).cast("string")
    return sums.select("file", stem.alias("stem"), series.alias("series"), "count")


def counter_days(files: DataFrame, *, drop_zero: bool = True, by_series: bool = False) -> DataFrame:
    """Files to days: dates that cannot be read are dropped, several files of a day are added up.

    ``drop_zero`` is the rule of the primary counter; secondary sites keep quiet days.
    """
    days = files.withColumn("date", day_of("stem"))
    return daily_sum(days, "count", series="series" if by_series else None, drop_zero=drop_zero)


def zero_days(files: DataFrame) -> DataFrame:
    return counter_days(files, drop_zero=False).where(F.col("count") == 0)
