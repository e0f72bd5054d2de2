"""Calendar, weather, lag, rolling and interaction features of a day table.

All windows run per series in date order on day-grain rows; one partitioning and one sort serve every lag and
rolling column of a call.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window
from pyspark.sql import functions as F

from daygauge.functions.scalars import flag, weather_severity
from daygauge.operators.daily import keys


def ordered(series=None, date: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys(series)).orderBy(date)


def shifted(column: str, by: int, window: WindowSpec) -> Column:
    """Positional shift as in a data frame library: positive looks back, negative ahead."""
    return F.lag(column, by).over(window) if by >= 0 else F.lead(column, -by).over(window)


def add_calendar(days: DataFrame, *, date: str = "date", holidays: DataFrame | None = None) -> DataFrame:
    """Day of week (0 = Monday), weekend, holiday, either, month.

    ``holidays`` is a dimension with a ``date`` column, a few dozen rows a year.
    """
    if holidays is None:
        out = days.withColumn("is_holiday", F.lit(0))
    else:
        marks = holidays.select(F.to_date("date").alias(date)).distinct().withColumn("is_holiday", F.lit(1))
        out = days.join(marks, date, "left").withColumn("is_holiday", F.coalesce("is_holiday", F.lit(0)))
    weekend = flag(F.weekday(date) >= 5)
    return out.withColumns({
        "dow": F.weekday(date),
        "is_weekend": weekend,
        "is_weekend_or_holiday": F.greatest(weekend, F.col("is_holiday")),
        "month": F.month(date),
    })


def add_severity(days: DataFrame, *, precip: str = "precip", wind: str = "wind", light: float = 0.0,
                 heavy: float = 10.0, strong: float = 8.0) -> DataFrame:
    return days.withColumn("weather_severity", weather_severity(precip, wind, light, heavy, strong))


def add_rolling(days: DataFrame, column: str, *, windows: Sequence[int] = (3, 7, 14), series=None,
                date: str = "date") -> DataFrame:
    """Mean of the current row and the w-1 rows before it, nulls skipped."""
    w = ordered(series, date)
    return days.withColumns({f"{column}_roll{n}": F.avg(column).over(w.rowsBetween(1 - n, 0)) for n in windows})


def add_lags(days: DataFrame, column: str, *, max_lag: int = 7, also: Sequence[str] = ("precip", "temp"), series=None,
             date: str = "date") -> DataFrame:
    """Lags 0..max_lag of a column by row position, and lag 1 of the ``also`` columns that exist."""
    w = ordered(series, date)
    lags = {f"{column}_lag{k}": shifted(column, k, w) for k in range(max_lag + 1)}
    lags |= {f"{c}_lag1": shifted(c, 1, w) for c in also if c in days.columns}
    return days.withColumns(lags)


def on_calendar(days: DataFrame, *, series=None, date: str = "date") -> DataFrame:
    """The same table with a row for every calendar day, so that positional lags become calendar lags."""
    by = keys(series)
    span = days.groupBy(*by).agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    spine = span.select(*by, F.explode(F.sequence("lo", "hi")).alias(date))
    return spine.join(days, [*by, date], "left")


def add_interactions(days: DataFrame, intent: str) -> DataFrame:
    off = F.col("is_weekend_or_holiday")
    return days.withColumns({
        "weekend_x_severity": off * F.col("weather_severity"),
        "weekend_x_intent": off * F.coalesce(F.col(intent), F.lit(0)),
    })


def add_weekday_mean(days: DataFrame, *, value: str = "count", series=None) -> DataFrame:
    """Mean of the value over the whole sample for the row's day of week."""
    w = Window.partitionBy(*keys(series), "dow")
    return days.withColumn(f"dow_mean_{value}", F.avg(value).over(w))


def feature_names(days: DataFrame | Sequence[str], intent: str) -> list[str]:
    """Model features in fixed order, reduced to those present."""
    wanted = [
        intent, f"{intent}_lag1", f"{intent}_lag2", f"{intent}_lag3", f"{intent}_roll7",
        "precip", "temp", "sun", "wind", "precip_lag1", "is_weekend_or_holiday", "weather_severity",
        "dow_mean_count", "weekend_x_severity", "weekend_x_intent", "month",
    ]
    have = set(days.columns if isinstance(days, DataFrame) else days)
    return [c for c in wanted if c in have]


# Features that count as weather in the ablation tests.
WEATHER_FEATURES = ("precip", "temp", "sun", "wind", "precip_lag1", "weather_severity", "weekend_x_severity")


def build_features(days: DataFrame, intent: str, *, series=None, date: str = "date",
                   holidays: DataFrame | None = None, light: float = 0.0, heavy: float = 10.0,
                   strong: float = 8.0) -> DataFrame:
    """All feature groups; ``feature_names`` gives the model's columns."""
    out = add_calendar(days, date=date, holidays=holidays)
    out = add_severity(out, light=light, heavy=heavy, strong=strong)
    out = add_rolling(out, intent, series=series, date=date)
    out = add_lags(out, intent, series=series, date=date)
    out = add_interactions(out, intent)
    return add_weekday_mean(out, series=series)


def complete_cases(days: DataFrame, target: str, features: Sequence[str], *, date: str = "date") -> DataFrame:
    return days.dropna(subset=[date, target, *features])


def weekday_profile(days: DataFrame, *columns: str, series=None) -> DataFrame:
    """Row count and means by day of week."""
    return (days.groupBy(*keys(series), "dow")
            .agg(F.count("*").alias("n_days"), *[F.avg(c).alias(f"mean_{c}") for c in columns]))


def weekday_spread(days: DataFrame, value: str = "count", *, series=None) -> DataFrame:
    """Five-number summary of a day table by day of week."""
    probs = F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)])
    names = ("minimum", "q25", "median", "q75", "maximum")
    out = days.groupBy(*keys(series), "dow").agg(F.percentile(value, probs).alias("q"))
    return out.select(*keys(series), "dow", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
