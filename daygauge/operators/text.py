"""Keyword mining of survey text; keywords always come from the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygauge.functions.distributions import chi2_p, correlation_p
from daygauge.functions.scalars import (contains_any, first_word, has_text, joined_text, mapped, pearson, percent_of,
                                        safe_divide)
from daygauge.operators.association import average_rank, yates_chi2
from daygauge.operators.daily import attach, keys

LOW, HIGH = (1, 2), (4, 5)


def _hit(text: Column, words: Sequence[str]) -> Column:
    return contains_any(text, words) & (F.length(F.trim(text)) >= 3)


def complaint_rates(answers: DataFrame, words: Sequence[str], *, texts: Sequence[str] = ("reason", "inconvenience", "freetext"),
                    satisfaction: str = "satisfaction", region: str | None = None, series=None) -> DataFrame:
    """Share of low and of high raters who mention a keyword, their ratio and the 2x2 test, in one pass over the text."""
    by = keys(series)
    rows = answers.where(has_text("prefecture", region)) if region else answers
    rows = rows.select(*by, F.col(satisfaction).isin(*LOW).alias("_low"), F.col(satisfaction).isin(*HIGH).alias("_high"),
                       _hit(joined_text(texts), words).alias("_hit"))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n_texts"), F.count_if("_low").alias("n_low"), F.count_if(F.col("_low") & F.col("_hit")).alias("low_hits"),
        F.count_if("_high").alias("n_high"), F.count_if(F.col("_high") & F.col("_hit")).alias("high_hits"))
    high_pct = F.when(F.col("n_high") > 0, percent_of(F.col("high_hits"), F.col("n_high"))).otherwise(0.01)
    out = out.withColumns({"low_pct": percent_of(F.col("low_hits"), F.col("n_low")), "high_pct": high_pct})
    chi2 = yates_chi2(F.col("low_hits"), F.col("n_low") - F.col("low_hits"), F.col("high_hits"),
                      F.col("n_high") - F.col("high_hits"))
    out = out.withColumns({"ratio": F.col("low_pct") / F.greatest("high_pct", F.lit(0.1)), "chi2": chi2})
    return out.withColumn("p", chi2_p(F.col("chi2")))


def complaint_examples(answers: DataFrame, words: Sequence[str], order: Sequence[str], *, limit: int = 5, chars: int = 120,
                       texts: Sequence[str] = ("reason", "inconvenience", "freetext"), satisfaction: str = "satisfaction",
                       region: str | None = None) -> DataFrame:
    """First rows by ``order`` of low raters with a keyword: rating, first keyword of the list, start of the text.

    The text is cut for display only, after the whole of it was searched.
    """
    rows = answers.where(has_text("prefecture", region)) if region else answers
    rows = rows.where(F.col(satisfaction).isin(*LOW)).withColumn("_t", joined_text(texts))
    hits = rows.where(_hit(F.col("_t"), words)).orderBy(*order).limit(limit)
    return hits.select(*order, F.col(satisfaction).alias("satisfaction"), first_word("_t", words).alias("keyword"),
                       F.substring("_t", 1, chars).alias("excerpt"))


def rating_number(satisfaction: str, labels: dict[str, int] | None) -> Column:
    """Rating as a number, through the label map where the column is text."""
    return mapped(satisfaction, labels).cast("double") if labels else F.col(satisfaction).try_cast("double")


def site_resilience(answers: DataFrame, location: str, *, crowd_words: Sequence[str], quiet_words: Sequence[str],
                    texts: Sequence[str] = ("freetext",), satisfaction: str = "satisfaction", date: str = "date",
                    labels: dict[str, int] | None = None, min_rows: int = 20, min_per_day: int = 3,
                    min_days: int = 10) -> DataFrame:
    """Satisfaction of one site against its own crowding, with complaint rates; no row below ``min_rows`` answers."""
    rating = rating_number(satisfaction, labels)
    rows = answers.where(has_text("location", location)).select(
        F.col(date).alias("_d"), rating.alias("_s"), joined_text(texts).alias("_t"))
    rows = rows.withColumns({"_low": F.coalesce(F.col("_s").isin(*LOW), F.lit(False)),
                             "_high": F.coalesce(F.col("_s").isin(*HIGH), F.lit(False)),
                             "_crowd": contains_any("_t", crowd_words), "_quiet": contains_any("_t", quiet_words)})
    counts = rows.agg(
        F.count("*").alias("n_responses"), F.count_if("_high").alias("n_high"), F.count_if("_low").alias("n_low"),
        F.count_if("_crowd").alias("n_crowd"), F.count_if(F.col("_crowd") & F.col("_low")).alias("n_crowd_low"),
        F.count_if(F.col("_quiet") & F.col("_low")).alias("n_quiet_low"))
    days = rows.where("_d is not null and _s is not null").groupBy("_d").agg(
        F.count("_s").alias("n"), F.avg("_s").alias("mean_sat")).where(F.col("n") >= min_per_day)
    density = days.withColumn("rel_density", relative_to_max("n"))
    ranked = density.select(average_rank("rel_density", []).alias("rx"), average_rank("mean_sat", []).alias("ry"))
    link = ranked.agg(F.count("*").alias("n_days"), pearson("rx", "ry").alias("rho"))
    link = link.withColumn("rho", F.when(F.col("n_days") >= min_days, F.col("rho")))
    out = attach(counts, link, [])
    p = correlation_p(F.col("rho"), F.col("n_days"))
    return out.where(F.col("n_responses") >= min_rows).select(
        "n_responses", "n_low", "n_days", F.bround("rho", 3).alias("spearman_r"), F.bround(p, 4).alias("spearman_p"),
        F.bround(percent_of(F.col("n_high"), F.col("n_responses")), 1).alias("sat_rate_pct"),
        F.bround(percent_of(F.col("n_crowd"), F.col("n_responses")), 1).alias("congestion_pct"),
        F.bround(safe_divide(F.col("n_crowd_low") * 100.0, "n_low"), 1).alias("congestion_low_sat_pct"),
        F.col("n_quiet_low").alias("undervibrancy_low_sat"))


def relative_to_max(column: str, *, series=None) -> Column:
    """Value as percent of the group's largest."""
    top = F.max(column).over(Window.partitionBy(*keys(series)))
    return F.col(column) * 100.0 / F.when(top != 0, top)
