"""Many sites at once: every step is grouped by the site column instead of looping over sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygauge.functions.scalars import canonical_label, has_text, matches_any, safe_divide
from daygauge.operators.association import best_lag, lag_correlations, pearson_test
from daygauge.operators.daily import attach, daily_rows, keys
from daygauge.operators.regression import fit_models, gram, standardised_beta
from daygauge.operators.text import relative_to_max
from daygauge.session import durable

NODE_WEATHER = ("temp", "precip", "wind", "snow_depth")


def region_counts(survey: DataFrame, regions: Sequence[str], *, date: str = "date") -> DataFrame:
    """Answers per day for each region, one row per day and a column per region, NULL where a region has none."""
    hits = [has_text("prefecture", r) for r in regions]
    flags = survey.where(F.col(date).isNotNull()).select(date, *[h.alias(f"_h{i}") for i, h in enumerate(hits)])
    counts = [F.count_if(f"_h{i}").alias(f"n_{i}") for i in range(len(regions))]
    return flags.groupBy(date).agg(*counts).select(
        date, *[F.when(F.col(f"n_{i}") > 0, F.col(f"n_{i}")).alias(f"n_{i}") for i in range(len(regions))])


def cross_region_ccf(days: DataFrame, survey: DataFrame, regions: Sequence[str], *, lags: Sequence[int] = tuple(range(-3, 8)),
                     count: str = "count", date: str = "date", min_pairs: int = 10, peak: float = 0.3) -> DataFrame:
    """Lag correlations of arrivals with each region's answer counts over days on which all of them exist."""
    counts = region_counts(survey, regions, date=date)
    merged = days.select(date, count).join(counts, date, "left").dropna()
    ccf = lag_correlations(merged, count, [f"n_{i}" for i in range(len(regions))], lags, date=date, min_pairs=min_pairs)
    name = F.coalesce(*[F.when(F.col("driver") == f"n_{i}", F.lit(r)) for i, r in enumerate(regions)])
    return ccf.select(name.alias("region"), "lag", "r", "n", F.coalesce(F.abs("r") > peak, F.lit(False)).alias("is_peak"))


def site_ccf(days: DataFrame, survey: DataFrame, region: str, *, site: str = "site", lags: Sequence[int] = tuple(range(-3, 8)),
             count: str = "count", date: str = "date", min_pairs: int = 20) -> DataFrame:
    """Best lag of one region's answer counts for every site."""
    counts = daily_rows(survey.where(has_text("prefecture", region)), date=date, out="answers")
    merged = days.select(site, date, count).join(counts, date, "inner").dropna()
    return best_lag(lag_correlations(merged, count, "answers", lags, series=site, date=date, min_pairs=min_pairs), series=site)


def site_model_table(counts: DataFrame, weather: DataFrame, intent_days: DataFrame, intent: str, *, site: str = "site",
                     date: str = "date", count: str = "count") -> DataFrame:
    """Counts, the site's own weather and shared intent on days that have all; absent snow counts as none."""
    on_weather = [k for k in (site, date) if k in weather.columns]
    rows = counts.join(weather, on_weather, "inner").join(intent_days.select(date, intent), date, "inner")
    rows = rows.dropna(subset=[count, intent, "temp", "precip", "wind"])
    snow = F.col("snow_depth").cast("double") if "snow_depth" in rows.columns else F.lit(None).cast("double")
    return rows.withColumn("snow_depth", F.coalesce(snow, F.lit(0.0)))


def site_metrics(model: DataFrame, intent: str, *, site: str = "site", count: str = "count", spend: float = 0.0,
                 min_rows: int = 60) -> DataFrame:
    """One row per site: fit, snow and wind sensitivity, weather lift, lost visitors against the intent-only line.

    Both regressions come from one cross-product row per site; the only second pass is the clipped shortfall.
    """
    features = [intent, *NODE_WEATHER]
    grams = gram(model, count, features, series=site).where(F.col("n") >= min_rows)
    coefs = fit_models(grams, features, {"full": features, "intent": [intent]}, series=site)

    def pick(model_name: str, term: str, column: str) -> Column:
        return F.max(F.when((F.col("model") == model_name) & (F.col("term") == term), F.col(column)))

    metrics = coefs.groupBy(site).agg(
        F.max("n").alias("n"), pick("full", "const", "r2").alias("r2"), pick("full", "const", "adj_r2").alias("adj_r2"),
        (pick("full", "const", "r2") - pick("intent", "const", "r2")).alias("weather_lift"),
        pick("full", "wind", "coef").alias("wind_coef"))
    snow = standardised_beta(coefs.where("model = 'full'"), "snow_depth", series=site).select(
        site, F.col("beta_std").alias("snow_beta_std"))
    line = coefs.groupBy(site).agg(pick("intent", "const", "coef").alias("_a"), pick("intent", intent, "coef").alias("_b"))
    lost = model.join(line, site).groupBy(site).agg(
        F.sum(F.greatest(F.col("_a") + F.col("_b") * F.col(intent) - F.col(count), F.lit(0.0))).alias("lost_visitors"))
    out = metrics.join(snow, site, "left").join(lost, site, "left")
    return out.withColumn("lost_value", F.col("lost_visitors") * F.lit(float(spend)))


def rank_sites(metrics: DataFrame, *, site: str = "site") -> DataFrame:
    """Sites by absolute snow sensitivity, unknown as none."""
    size = F.coalesce(F.abs("snow_beta_std"), F.lit(0.0))
    return metrics.select(site, size.alias("snow_sensitivity")).orderBy(F.col("snow_sensitivity").desc(), site)


def most_and_least(metrics: DataFrame, *, site: str = "site") -> DataFrame:
    size = F.coalesce(F.abs("snow_beta_std"), F.lit(0.0))
    return metrics.agg(F.max_by(site, size).alias("most_sensitive"), F.min_by(site, size).alias("least_sensitive"))


def site_totals(metrics: DataFrame, spend: float) -> DataFrame:
    return metrics.agg(F.count("*").alias("n_sites"), F.sum("lost_visitors").alias("lost_visitors")).withColumn(
        "lost_value", F.col("lost_visitors") * F.lit(float(spend)))


def sensitivity_table(metrics: DataFrame, *, site: str = "site", normalise: bool = False) -> DataFrame:
    """Absolute sensitivities per site; normalised, each column over its largest value (an all-zero column stays 0)."""
    out = metrics.select(site, F.abs("snow_beta_std").alias("snow_sensitivity_abs"), F.abs("wind_coef").alias("wind_sensitivity_abs"),
                         F.col("weather_lift").alias("weather_lift_r2"), (F.col("lost_visitors") / 1000).alias("lost_visitors_k"))
    if not normalise:
        return out
    out = durable(out)  # read twice, and the largest has to be a value of the table to the last bit
    measures = [c for c in out.columns if c != site]
    rows = attach(out, out.agg(*[F.max(c).alias(f"_top_{c}") for c in measures]), [])
    return rows.select(site, *[(F.col(c) / F.when(F.col(f"_top_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_top_{c}"))).alias(c) for c in measures])


def side_by_side(days: DataFrame, sites: Sequence[str], *, site: str = "site", date: str = "date", count: str = "count",
                 wind: str = "wind") -> DataFrame:
    """Days on which every named site has a count: one count column per site, wind of the first one.

    One grouped aggregation stands in for the chain of joins.
    """
    rows = days.where(F.col(site).isin(*sites))
    wide = rows.groupBy(date).agg(
        *[F.max(F.when(F.col(site) == s, F.col(count))).alias(f"count_{i}") for i, s in enumerate(sites)],
        F.max(F.when(F.col(site) == sites[0], F.col(wind))).alias("wind"))
    return wide.dropna(subset=[f"count_{i}" for i in range(len(sites))])


def _change(part: Column, base: Column) -> Column:
    return (safe_divide(part, base) - 1) * 100


def wind_nudge(wide: DataFrame, *, threshold: float = 10.0, n_sites: int = 3, min_days: int = 10) -> DataFrame:
    """Percent change of mean counts on windy against other days; no row unless both sides have ``min_days``."""
    windy, calm = F.col("wind") > threshold, F.col("wind") <= threshold
    aggs = [c for i in range(n_sites) for c in (F.avg(F.when(windy, F.col(f"count_{i}"))).alias(f"_h{i}"),
                                                F.avg(F.when(calm, F.col(f"count_{i}"))).alias(f"_c{i}"))]
    out = wide.agg(F.count_if(windy).alias("n_high"), F.count_if(calm).alias("n_normal"), *aggs)
    out = out.where((F.col("n_high") >= min_days) & (F.col("n_normal") >= min_days))
    return out.select("n_high", "n_normal", *[
        _change(F.col(f"_h{i}"), F.col(f"_c{i}")).alias(f"delta_pct_{i}") for i in range(n_sites)])


def weather_shield(wide: DataFrame, *, threshold: float = 10.0, first: int = 0, sheltered: int = 2, min_days: int = 8) -> DataFrame:
    """Change at the sheltered site on windy days with a below-median count at the first site."""
    wide = durable(wide)
    rows = attach(wide, wide.agg(F.median(f"count_{first}").alias("_med")), [])
    shield = (F.col("wind") > threshold) & (F.col(f"count_{first}") < F.col("_med"))
    target = F.col(f"count_{sheltered}")
    out = rows.agg(F.count_if(shield).alias("n_shield"), F.avg(F.when(shield, target)).alias("_s"),
                   F.avg(F.when(F.col("wind") <= threshold, target)).alias("_c"))
    return out.where(F.col("n_shield") >= min_days).select("n_shield", _change(F.col("_s"), F.col("_c")).alias("shield_pct"))


def survey_proxy(survey: DataFrame, columns: Sequence[str], pattern: str, *, date: str = "date") -> DataFrame:
    """Daily number of answers that mention a place in any of the columns that exist: a stand-in for a counter."""
    have = [c for c in columns if c in survey.columns]
    return daily_rows(survey.where(matches_any(have, pattern)), date=date)


def with_proxy_sites(counts: DataFrame, proxy: DataFrame, proxy_site: str, *, site: str = "site") -> DataFrame:
    """Counter days plus the proxy's days for a site without a counter; a site that has counts keeps them alone."""
    own_days = counts.where(F.col(site) == proxy_site).agg(F.count("*").alias("n")).scalar()
    stand_in = proxy.withColumn(site, F.lit(proxy_site)).where(own_days == 0)
    marked = counts.withColumn("source", F.lit("counter"))
    return marked.unionByName(stand_in.withColumn("source", F.lit("survey_proxy")))


def proxy_check(days: DataFrame, proxy_days: DataFrame, *, count: str = "count", date: str = "date", min_days: int = 30) -> DataFrame:
    both = days.select(date, count).join(proxy_days.select(date, F.col("count").alias("_proxy")), date, "inner").dropna()
    return pearson_test(both, count, "_proxy", min_rows=min_days)


def demand_table(survey: DataFrame, regions: Sequence[str], *, region: str = "prefecture", date: str = "date") -> DataFrame:
    """Answers per month, one column per region, absent combinations 0."""
    rows = survey.withColumn("_r", canonical_label(region, regions)).where(F.col("_r") != "Other")
    return (rows.groupBy(F.date_format(date, "yyyy-MM").alias("month")).pivot("_r", list(regions))
            .agg(F.count(F.lit(1))).fillna(0))


def region_day_table(survey: DataFrame, regions: Sequence[str], *, region: str = "prefecture", date: str = "date") -> DataFrame:
    rows = survey.withColumn("_r", canonical_label(region, regions)).where(F.col("_r") != "Other")
    return rows.groupBy(date).pivot("_r", list(regions)).agg(F.count(F.lit(1))).fillna(0)


def heat_rank(metrics: DataFrame, value: str, *, series=None) -> DataFrame:
    """A metric with its percent of the largest."""
    return metrics.select(*keys(series), value, relative_to_max(value).alias("relative"))


def on_common_days(days: DataFrame, *, site: str = "site", date: str = "date") -> DataFrame:
    """Rows of days on which every site reports."""
    sites = days.select(F.count_distinct(site).alias("_sites"))
    here = F.count("*").over(Window.partitionBy(date))
    return attach(days.withColumn("_here", here), sites, []).where("_here = _sites").drop("_here", "_sites")
