"""Day-grain tables.

Everything downstream works on one row per series and day. The reduction from readings to days is one shuffle with
partial sums on the map side, so a site holding a third of all readings arrives as at most one row per task and day.
After it a series is as long as its calendar, which is what bounds every window in this package.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygauge.functions.scalars import holds, sum_or_zero


def keys(series: Sequence[str] | str | None) -> list[str]:
    if series is None:
        return []
    return [series] if isinstance(series, str) else list(series)


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Columns of a table with one row per group on every row of the group.

    Without groups the one row is a scalar subquery; with groups it is an equi-join whose strategy the planner picks
    from the measured size.
    """
    if by:
        return df.join(stats, list(by), "left")
    one = stats.select(F.struct(*stats.columns).alias("_one")).scalar()
    return df.withColumn("_one", one).select(*df.columns, *[F.col(f"_one.{c}").alias(c) for c in stats.columns])


def daily_sum(readings: DataFrame, value: str, *, date: str = "date", series=None, out: str = "count",
              drop_zero: bool = False) -> DataFrame:
    """Counter readings to day totals; ``drop_zero`` removes days on which the counter was silent."""
    days = (readings.where(F.col(date).isNotNull())
            .groupBy(*keys(series), date).agg(F.sum(value).alias(out)))
    return days.where(F.col(out) > 0) if drop_zero else days


def daily_measures(readings: DataFrame, *, date: str = "date", series=None, sums: Mapping[str, str] | None = None,
                   means: Mapping[str, str] | None = None) -> DataFrame:
    """Hourly to daily: totals (all-null day is 0) and means (all-null day is NULL) of the columns that exist."""
    have = set(readings.columns)
    aggs = [sum_or_zero(c).alias(o) for c, o in (sums or {}).items() if c in have]
    aggs += [F.avg(c).alias(o) for c, o in (means or {}).items() if c in have]
    return readings.groupBy(*keys(series), date).agg(*aggs)


def daily_rows(rows: DataFrame, *, date: str = "date", series=None, out: str = "count") -> DataFrame:
    """Number of rows per day."""
    return rows.where(F.col(date).isNotNull()).groupBy(*keys(series), date).agg(F.count("*").alias(out))


def join_daily(counts: DataFrame, *others: DataFrame, date: str = "date", series=None, count: str = "count",
               how: str = "left") -> DataFrame:
    """Counts joined to further day tables; days without a count are dropped, other gaps stay NULL.

    A table that carries no series column (intent, national weather) is joined by date alone.
    """
    out = counts
    for other in others:
        on = [k for k in keys(series) if k in other.columns] + [date]
        out = out.join(other, on, how)
    return out.where(F.col(count).isNotNull())


def flag_outliers(days: DataFrame, value: str, *, series=None, k: float = 1.5, out: str = "is_outlier") -> DataFrame:
    """Interquartile fence flag on a day table (``quality.column_profile`` is the form for raw columns)."""
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).over(Window.partitionBy(*keys(series)))
    spread = k * (F.col("_q")[1] - F.col("_q")[0])
    outside = (F.col(value) < F.col("_q")[0] - spread) | (F.col(value) > F.col("_q")[1] + spread)
    return days.withColumn("_q", quartiles).withColumn(out, holds(outside)).drop("_q")


def missing_days(days: DataFrame, *, date: str = "date", series=None) -> DataFrame:
    """Calendar days between a series' first and last day on which it has no row.

    The hole after each day is opened up to the next day seen, so neither a calendar nor an anti-join is needed.
    """
    by = keys(series)
    seen = days.select(*by, F.to_date(date).alias("date")).where("date is not null").distinct()
    following = F.lead("date").over(Window.partitionBy(*by).orderBy("date"))
    holes = seen.withColumn("_next", following).where(F.datediff("_next", "date") > 1)
    return holes.select(*by, F.explode(F.sequence(F.date_add("date", 1), F.date_sub("_next", 1))).alias("date"))


def coverage(rows: DataFrame, *, date: str = "date", series=None) -> DataFrame:
    """First day, last day and number of rows."""
    return rows.groupBy(*keys(series)).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"),
                                           F.count("*").alias("n_rows"))
