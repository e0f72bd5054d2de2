"""Demand gap: days with interest but few arrivals, what they cost, and what recovering them would change."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygauge.functions.scalars import flag, safe_divide
from daygauge.operators.daily import attach, keys
from daygauge.operators.regression import ablation


def opportunity_gap(days: DataFrame, intent: str, *, count: str = "count", series=None) -> DataFrame:
    """Flags: intent above its median, count below its median, both (strict; unknown is 0)."""
    w = Window.partitionBy(*keys(series))
    out = days.withColumns({"_mi": F.median(intent).over(w), "_mc": F.median(count).over(w)})
    return out.withColumns({
        "high_intent": flag(F.col(intent) > F.col("_mi")),
        "low_count": flag(F.col(count) < F.col("_mc")),
    }).withColumn("opportunity_gap", F.col("high_intent") * F.col("low_count")).drop("_mi", "_mc")


def gap_profile(flagged: DataFrame, columns: Sequence[str], *, series=None) -> DataFrame:
    """Mean of each column on gap days, on other days, and the difference, in one aggregation."""
    by, on_gap = keys(series), F.col("opportunity_gap") == 1
    aggs = [c for col in columns for c in (F.avg(F.when(on_gap, F.col(col))).alias(f"_g_{col}"),
                                           F.avg(F.when(~on_gap, F.col(col))).alias(f"_o_{col}"))]
    wide = flagged.groupBy(*by).agg(F.count_if(on_gap).alias("gap_days"), F.count("*").alias("n_days"), *aggs)
    return wide.select(*by, "gap_days", "n_days", F.inline(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(f"_g_{c}").alias("gap_mean"), F.col(f"_o_{c}").alias("other_mean"),
                 (F.col(f"_g_{c}") - F.col(f"_o_{c}")).alias("difference")) for c in columns])))


def top_gap_days(flagged: DataFrame, intent: str, *, k: int = 10, date: str = "date") -> DataFrame:
    return flagged.where("opportunity_gap = 1").orderBy(F.col(intent).desc(), date).limit(k)


def lost_on_gap_days(predicted: DataFrame, flagged: DataFrame, *, count: str = "count", date: str = "date",
                     series=None) -> DataFrame:
    """Gap days of the model table with ``lost_population`` = predicted minus actual (signed)."""
    on = [*keys(series), date]
    marks = flagged.select(*on, "opportunity_gap").dropDuplicates()
    rows = predicted.drop("opportunity_gap").join(marks, on, "left")
    rows = rows.withColumn("opportunity_gap", F.coalesce("opportunity_gap", F.lit(0)))
    return rows.where("opportunity_gap = 1").withColumn("lost_population", F.col("predicted") - F.col(count))


def lost_summary(gap_days: DataFrame, *, series=None) -> DataFrame:
    return gap_days.groupBy(*keys(series)).agg(
        F.count("*").alias("gap_days"), F.coalesce(F.sum("lost_population"), F.lit(0.0)).alias("total_lost"),
        F.avg("lost_population").alias("mean_lost"))


def shortfall(predicted: DataFrame, *, count: str = "count", series=None) -> DataFrame:
    """Sum of the positive part of predicted minus actual over all days."""
    return predicted.groupBy(*keys(series)).agg(
        F.sum(F.greatest(F.col("predicted") - F.col(count), F.lit(0.0))).alias("lost_visitors"))


def economic_value(df: DataFrame, lost: str, spend: float, usd_rate: float) -> DataFrame:
    value = F.col(lost) * F.lit(float(spend))
    return df.withColumns({"value": value, "value_billion": value / 1e9, "value_usd_million": value / usd_rate / 1e6})


def monthly_loss(gap_days: DataFrame, *, date: str = "date", series=None) -> DataFrame:
    return gap_days.groupBy(*keys(series), F.month(date).alias("month")).agg(F.sum("lost_population").alias("monthly_lost"))


def spread_by_weight(months: DataFrame, total: DataFrame, lost: str, weights: Mapping[int, float] | None = None,
                     *, series=None) -> DataFrame:
    """A total distributed over the 12 months by weights (evenly without weights)."""
    weights = {m: 1.0 for m in range(1, 13)} if weights is None else weights
    share = F.try_element_at(F.create_map(*[F.lit(v) for kv in weights.items() for v in kv]), F.col("month"))
    by = keys(series)
    if by:
        grid = total.select(*by, F.col(lost).alias("_t"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    else:
        grid = attach(months.select("month"), total.select(F.col(lost).alias("_t")), by)
    return grid.select(*by, "month", (F.col("_t") * share / sum(weights.values())).alias("monthly_lost"))


def rank_simulation(baseline: DataFrame, monthly: DataFrame, *, series=None, floor: int = 1, top: int = 12) -> DataFrame:
    """Rank per month after recovering the monthly loss.

    ``baseline`` is the 12-row dimension (month, rank, gap_k). Closure is the loss in thousands over the gap; the ranks
    gained are the closure times ``top``, truncated, at most ``top``; the rank cannot pass ``floor``.
    """
    by = keys(series)
    base = baseline
    if by:
        base = monthly.select(*by).distinct().withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12)))).join(
            baseline, "month")
    out = base.join(monthly, [*by, "month"], "left")
    lost_k = F.coalesce(F.col("monthly_lost"), F.lit(0.0)) / 1000
    counts = (F.col("gap_k") > 0) & (lost_k > 0)
    closure = F.when(counts, lost_k / F.when(F.col("gap_k") > 0, F.col("gap_k"))).otherwise(0.0)
    gained = F.least(F.lit(top), (closure * top).cast("long")).cast("int")
    return out.select(*by, "month", "rank", "gap_k", F.coalesce("monthly_lost", F.lit(0.0)).alias("monthly_lost"),
                      (closure * 100).alias("closure_pct"), gained.alias("ranks_gained"),
                      F.greatest(F.lit(floor), F.col("rank") - gained).cast("int").alias("new_rank"))


def rank_summary(sim: DataFrame, *, series=None, winter: Sequence[int] = (12, 1, 2)) -> DataFrame:
    cold: Column = F.col("month").isin(*winter)
    closable = F.when(F.col("gap_k") > 0, F.col("closure_pct"))
    return sim.groupBy(*keys(series)).agg(
        F.avg(F.when(cold, F.col("rank"))).alias("winter_rank"), F.avg(F.when(cold, F.col("new_rank"))).alias("winter_new_rank"),
        F.max("ranks_gained").alias("best_gain"), F.coalesce(F.min(closable), F.lit(0.0)).alias("min_closure_pct"),
        F.coalesce(F.max(closable), F.lit(0.0)).alias("max_closure_pct"))


def seasonal_lift(df: DataFrame, target: str, features: Sequence[str], weather: Sequence[str], *, date: str = "date",
                  series=None, min_rows: int = 15, summer: Sequence[int] = (6, 7, 8),
                  winter: Sequence[int] = (12, 1, 2)) -> DataFrame:
    """R squared gained by the weather features in summer and in winter; both seasons in one grouped fit."""
    by, month = keys(series), F.month(date)
    season = F.when(month.isin(*summer), "summer").when(month.isin(*winter), "winter")
    rows = df.withColumn("season", season).where(F.col("season").isNotNull())
    return ablation(rows, target, features, weather, series=[*by, "season"], min_rows=min_rows)


def season_ratio(lifts: DataFrame, *, series=None) -> DataFrame:
    """Winter lift over summer lift; infinite when summer shows none, a skipped season counts as 0."""
    def lift(s: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("season") == s, F.col("lift"))), F.lit(0.0))

    out = lifts.groupBy(*keys(series)).agg(lift("summer").alias("summer_lift"), lift("winter").alias("winter_lift"))
    ratio = safe_divide("winter_lift", F.greatest("summer_lift", F.lit(0.0)))
    return out.withColumn("ratio", F.coalesce(ratio, F.lit(float("inf"))))
