"""Comfort indices against satisfaction, and satisfaction against crowding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygauge.functions.scalars import bin_by_edges, cut, discomfort_index, has_text, wind_chill
from daygauge.operators.association import spearman
from daygauge.operators.daily import keys
from daygauge.session import durable

# Visitor bins of the crowding analysis, right-closed.
VISITOR_EDGES = (0, 5000, 8000, 12000, 15000, 20000, 50000)
VISITOR_LABELS = ("<5K", "5-8K", "8-12K", "12-15K", "15-20K", ">20K")


def comfort_days(weather: DataFrame, *, series=None, proxy_humidity: float = 60.0, min_humidity: int = 30,
                 terms: Sequence[float] | None = None) -> DataFrame:
    """``discomfort_index`` (and ``wind_chill`` where wind exists) per day.

    Humidity is used by a series only with more than ``min_humidity`` readings of it; otherwise the proxy stands in.
    """
    proxy = discomfort_index("temp", F.lit(proxy_humidity), terms)
    if "humidity" in weather.columns:
        known = F.count("humidity").over(Window.partitionBy(*keys(series)))
        index = F.when(known > min_humidity, discomfort_index("temp", "humidity", terms)).otherwise(proxy)
    else:
        index = proxy
    out = weather.withColumn("discomfort_index", index)
    return out.withColumn("wind_chill", wind_chill("temp", "wind")) if "wind" in weather.columns else out


def comfort_means(days: DataFrame, *, series=None) -> DataFrame:
    columns = [F.avg("discomfort_index").alias("di_mean")]
    if "wind_chill" in days.columns:
        columns.append(F.avg("wind_chill").alias("wc_mean"))
    return days.groupBy(*keys(series)).agg(*columns)


def comfort_correlations(days: DataFrame, satisfaction: DataFrame, *, date: str = "date", series=None,
                         min_days: int = 20, min_pairs: int = 10) -> DataFrame:
    """Rank correlation of the indices with mean satisfaction and mean recommendation on matching days."""
    on = [*[k for k in keys(series) if k in satisfaction.columns], date]
    merged = days.join(satisfaction, on, "inner")
    matches = F.count("*").over(Window.partitionBy(*keys(series)))
    merged = merged.withColumn("_matches", matches).where(F.col("_matches") > min_days)
    pairs = [("discomfort_index", "mean_satisfaction")]
    if "wind_chill" in days.columns:
        pairs.append(("wind_chill", "mean_satisfaction"))
    if "mean_nps" in satisfaction.columns:
        pairs.append(("discomfort_index", "mean_nps"))
    out = spearman(merged, pairs, series=series)
    first = (F.col("x") == pairs[0][0]) & (F.col("y") == pairs[0][1])
    return out.where(first | (F.col("n") > min_pairs))


def quantile_bins(df: DataFrame, column: str, *, q: int = 5, series=None, out: str = "bin") -> DataFrame:
    """Equal-frequency bins of a day table as struct(left, right, mid); equal edges fall together."""
    probs = F.array(*[F.lit(i / q) for i in range(q + 1)])
    edges = F.array_distinct(F.percentile(column, probs).over(Window.partitionBy(*keys(series))))
    return df.withColumn("_edges", edges).withColumn(out, bin_by_edges(column, F.col("_edges"))).drop("_edges")


def best_bin(df: DataFrame, column: str, target: str, *, q: int = 5, series=None, min_rows: int = 30) -> DataFrame:
    """Bin of the column with the highest mean target, the lowest bin on a tie."""
    by = keys(series)
    rows = df.dropna(subset=[column, target])
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).where(F.col("_n") > min_rows)
    means = quantile_bins(rows, column, q=q, series=series).where(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(
        F.avg(target).alias("mean_target"), F.count("*").alias("n"))
    order = F.struct("mean_target", -F.col("bin.left"))
    return means.groupBy(*by).agg(F.max_by(F.struct("bin", "mean_target", "n"), order).alias("b")).select(
        *by, F.col("b.bin.left").alias("peak_left"), F.col("b.bin.right").alias("peak_right"),
        F.col("b.bin.mid").alias("peak_mid"), F.col("b.mean_target").alias("peak_mean"), F.col("b.n").alias("peak_n"))


def satisfaction_daily(survey: DataFrame, *, region: str | None = None, date: str = "date") -> DataFrame:
    """Mean satisfaction, answered count and optional means per day, for one region if named."""
    rows = survey.where(has_text("prefecture", region)) if region else survey
    aggs = [F.avg("satisfaction").alias("mean_satisfaction"), F.count("satisfaction").alias("n_responses"),
            (F.avg("nps_raw") if "nps_raw" in survey.columns else F.lit(None).cast("double")).alias("mean_nps")]
    if "satisfaction_service" in survey.columns:
        aggs.append(F.avg("satisfaction_service").alias("mean_service"))
    return rows.where(F.col(date).isNotNull()).groupBy(date).agg(*aggs)


def monthly_satisfaction(sat: DataFrame, *, date: str = "date") -> DataFrame:
    """Mean of daily means and total answers per month, dated on its first day."""
    return sat.groupBy(F.trunc(date, "MM").alias(date)).agg(
        F.avg("mean_satisfaction").alias("mean_satisfaction"), F.sum("n_responses").alias("n_responses"),
        F.avg("mean_nps").alias("mean_nps"))


def match_satisfaction(days: DataFrame, sat: DataFrame, *, count: str = "count", date: str = "date",
                       min_days: int = 20) -> DataFrame:
    """Counts with satisfaction by day, or by month when no more than ``min_days`` days match.

    The choice needs one action, for which the matched days (one row each) are written.
    """
    counts = days.select(date, F.col(count).cast("double").alias("count"))
    daily = durable(counts.join(sat, date, "inner"))
    if daily.limit(min_days + 1).count() > min_days:
        return daily.select(date, "count", "mean_satisfaction", "n_responses", "mean_nps")
    monthly = counts.groupBy(F.trunc(date, "MM").alias(date)).agg(F.avg("count").alias("count"))
    return monthly.join(monthly_satisfaction(sat, date=date), date, "inner").select(
        date, "count", "mean_satisfaction", "n_responses", "mean_nps")


def crowding_bins(matched: DataFrame, *, edges: Sequence[float] = VISITOR_EDGES,
                  labels: Sequence[str] = VISITOR_LABELS) -> DataFrame:
    return (matched.withColumn("visitor_bin", cut("count", edges, labels)).where(F.col("visitor_bin").isNotNull())
            .groupBy("visitor_bin").agg(F.avg("mean_satisfaction").alias("mean_satisfaction"),
                                        F.avg("mean_nps").alias("mean_nps"), F.count("*").alias("n")))


def crowding_correlations(matched: DataFrame, *, min_rows: int = 4) -> DataFrame:
    """Rank correlation of visitors with satisfaction and with recommendation (satisfaction where that is missing)."""
    rows = matched.dropna(subset=["mean_satisfaction", "count"]).withColumn(
        "nps_or_satisfaction", F.coalesce("mean_nps", "mean_satisfaction"))
    return spearman(rows, [("count", "mean_satisfaction"), ("count", "nps_or_satisfaction")], min_rows=min_rows)
