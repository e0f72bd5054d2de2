"""Correlation, rank correlation, lag correlation and contingency tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygauge.functions.distributions import chi2_p, correlation_p
from daygauge.functions.scalars import pair_count, pearson, signal_band
from daygauge.operators.daily import keys
from daygauge.operators.features import ordered, shifted
from daygauge.operators.moments import pair_correlations


def _name_at(names: Sequence, index: str) -> Column:
    return F.get(F.array(*[F.lit(v) for v in names]), F.col(index))


def correlation_pairs(df: DataFrame, columns: Sequence[str], *, series=None) -> DataFrame:
    """Pearson r of every column pair, pairwise complete, in one aggregation of matrices: (col_a, col_b, r, n)."""
    return pair_correlations(df, columns, series=series)


def pearson_test(df: DataFrame, a: str, b: str, *, series=None, min_rows: int = 3) -> DataFrame:
    """r, n and two-sided p per series; series with too few pairs give no row."""
    out = df.groupBy(*keys(series)).agg(pearson(a, b).alias("r"), pair_count(a, b).alias("n"))
    return out.where(F.col("n") >= min_rows).withColumn("p", correlation_p(F.col("r"), F.col("n")))


#: Decimals of a rank key: values that differ by less count as tied, so that ranks do not hang on the last bit of a sum.
RANK_DECIMALS = 9


def average_rank(column: str, by: Sequence[str], decimals: int = RANK_DECIMALS) -> Column:
    """Rank within the group with ties averaged; values that agree after rounding to ``decimals`` are tied."""
    key = F.round(F.col(column).cast("double"), decimals)
    ties = Window.partitionBy(*by, key)
    return F.rank().over(Window.partitionBy(*by).orderBy(key)) + (F.count("*").over(ties) - 1) / 2


def spearman(days: DataFrame, pairs: Sequence[tuple[str, str]], *, series=None, min_rows: int = 3) -> DataFrame:
    """Rank correlation with its p for each column pair on a day table: (x, y, rho, n, p).

    Ranks need a total order per series, so the input must be day-grain (bounded by the calendar).
    """
    by, pairs = keys(series), list(pairs)
    sides = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
             for x, y in pairs]
    group = [*by, "x", "y"]
    rows = days.select(*by, F.inline(F.array(*sides))).where("_x is not null and _y is not null")
    ranked = rows.select(*group, average_rank("_x", group).alias("rx"), average_rank("_y", group).alias("ry"))
    out = ranked.groupBy(*group).agg(pearson("rx", "ry").alias("rho"), F.count("*").alias("n")).where(F.col("n") >= min_rows)
    return out.withColumn("p", correlation_p(F.col("rho"), F.col("n")))


def lag_correlations(days: DataFrame, target: str, driver: str | Sequence[str], lags: Sequence[int], *, series=None,
                     date: str = "date", min_pairs: int = 0) -> DataFrame:
    """r of the target with the driver shifted by each lag: (lag, r, n), with a ``driver`` column for several drivers.

    All shifted columns come from one window sort and all coefficients from one aggregation.
    """
    by, w, lags = keys(series), ordered(series, date), list(lags)
    drivers = keys(driver)
    wide = days.select(*by, F.col(target).alias("_y"), F.array(*[
        shifted(d, k, w).cast("double") for d in drivers for k in lags]).alias("_v"))
    long = wide.select(*by, "_y", F.posexplode("_v").alias("_i", "_x"))
    out = long.groupBy(*by, "_i").agg(pearson("_y", "_x").alias("r"), pair_count("_y", "_x").alias("n"))
    named = [] if isinstance(driver, str) else [_name_at([d for d in drivers for _ in lags], "_i").alias("driver")]
    return out.select(*by, *named, _name_at(lags * len(drivers), "_i").alias("lag"), "r", "n").where(F.col("n") > min_pairs)


def best_lag(ccf: DataFrame, *, series=None) -> DataFrame:
    """Lag of the largest absolute r per series, the lowest lag on a tie."""
    order = F.struct(F.abs("r"), -F.col("lag"))
    return (ccf.where(F.col("r").isNotNull()).groupBy(*keys(series))
            .agg(F.max_by(F.struct("lag", "r", "n"), order).alias("b"))
            .select(*keys(series), F.col("b.lag").alias("best_lag"), F.col("b.r").alias("best_r"),
                    F.col("b.n").alias("best_n"), signal_band("b.r").alias("strength")))


def two_by_two(df: DataFrame, hit: Column, group_a: Column, group_b: Column, *, series=None) -> DataFrame:
    """Hit counts of two groups of rows in one pass."""
    return df.groupBy(*keys(series)).agg(
        F.count_if(group_a & hit).alias("hits_a"), F.count_if(group_a).alias("n_a"),
        F.count_if(group_b & hit).alias("hits_b"), F.count_if(group_b).alias("n_b"))


def yates_chi2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square of the table [[a, b], [c, d]] with continuity correction; NULL when a margin is empty."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    n = a + b + c + d
    short = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    return n * short * short / F.when(margins > 0, margins)


def proportion_test(table: DataFrame) -> DataFrame:
    """chi2 and p for the output of ``two_by_two``."""
    chi2 = yates_chi2(F.col("hits_a"), F.col("n_a") - F.col("hits_a"), F.col("hits_b"), F.col("n_b") - F.col("hits_b"))
    return table.withColumn("chi2", chi2).withColumn("p", chi2_p(F.col("chi2")))
