"""Time-series diagnostics of a regression on day tables: Durbin-Watson, Newey-West, differences, lagged target, ADF."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygauge.functions.distributions import mackinnon_p, normal_two_sided
from daygauge.functions.scalars import autocorrelation_free, safe_divide
from daygauge.operators.daily import attach, keys
from daygauge.operators.features import ordered
from daygauge.operators.moments import complete_moments
from daygauge.operators.regression import fit_models, gram, ols, predict, solve_block, unpack
from daygauge.session import durable


def with_residuals(df: DataFrame, target: str, features: Sequence[str], *, series=None) -> tuple[DataFrame, DataFrame]:
    """(coefficient table, complete rows with ``residual``)."""
    rows = df.dropna(subset=[target, *features])
    coefs = ols(rows, target, features, series=series)
    fitted = predict(rows, coefs, features, series=series)
    return coefs, fitted.withColumn("residual", F.col(target) - F.col("predicted"))


def durbin_watson(rows: DataFrame, residual: str = "residual", *, date: str = "date", series=None) -> DataFrame:
    step = F.col(residual) - F.lag(residual).over(ordered(series, date))
    out = rows.select(*keys(series), F.col(residual).alias("_e"), step.alias("_d"))
    out = out.groupBy(*keys(series)).agg(
        safe_divide(F.sum(F.col("_d") * F.col("_d")), F.sum(F.col("_e") * F.col("_e"))).alias("dw"))
    return out.withColumn("dw_clean", autocorrelation_free("dw"))


def _fit_and_dw(rows: DataFrame, target: str, features: Sequence[str], date: str, series) -> tuple[DataFrame, DataFrame]:
    coefs, fitted = with_residuals(rows, target, features, series=series)
    return coefs, durbin_watson(fitted, date=date, series=series)


def differences(df: DataFrame, columns: Sequence[str], *, date: str = "date", series=None) -> DataFrame:
    """First differences of the columns in date order; the first row of a series has none."""
    w = ordered(series, date)
    return df.select(*keys(series), date, *[(F.col(c) - F.lag(c).over(w)).alias(c) for c in columns])


def first_difference_fit(df: DataFrame, target: str, features: Sequence[str], *, date: str = "date",
                         series=None) -> tuple[DataFrame, DataFrame]:
    """(coefficients, Durbin-Watson) of the regression in first differences."""
    changed = differences(df, [target, *features], date=date, series=series).dropna(subset=[target, *features])
    return _fit_and_dw(changed, target, features, date, series)


def with_lagged_target(df: DataFrame, target: str, *, date: str = "date", series=None) -> DataFrame:
    return df.withColumn(f"{target}_lag1", F.lag(target).over(ordered(series, date)))


def lagged_target_fit(df: DataFrame, target: str, features: Sequence[str], *, date: str = "date",
                      series=None) -> tuple[DataFrame, DataFrame]:
    """(coefficients, Durbin-Watson) with yesterday's target as a further regressor."""
    rows = with_lagged_target(df.dropna(subset=[target, *features]), target, date=date, series=series)
    used = [*features, f"{target}_lag1"]
    return _fit_and_dw(rows.dropna(subset=used), target, used, date, series)


def newey_west(df: DataFrame, target: str, features: Sequence[str], *, date: str = "date", series=None) -> DataFrame:
    """OLS coefficients with HAC errors: Bartlett kernel, L = max(1, int(0.75 n^(1/3))), normal p-values.

    The Bartlett-weighted sum of autocovariances of the scores u_t = x_t e_t equals the plain cross-product of their
    moving sums over L+1 rows (windows hanging over either end included) divided by L+1. Moving sums are differences of
    running sums, so the middle of the sandwich is one window, one positional self-join and one aggregation, for any
    mix of series lengths.
    """
    by, features = keys(series), list(features)
    rows = durable(df.dropna(subset=[target, *features]).select(*by, date, target, *features))
    grams = durable(gram(rows, target, features, series=series))
    fitted = predict(rows, fit_models(grams, features, series=series), features, series=series)
    w = ordered(series, date)
    terms = range(len(features) + 1)
    error = F.col(target) - F.col("predicted")
    # Regressors are centred first; that is a change of basis which the solve undoes.
    centred = attach(fitted, grams.select(*by, "means"), by)
    score = [error, *[(F.col(c) - F.col("means")[i]) * error for i, c in enumerate(features)]]
    scores = centred.select(*by, date, F.row_number().over(w).alias("_pos"),
                            F.count("*").over(Window.partitionBy(*by)).alias("_n"),
                            *[s.alias(f"_u{i}") for i, s in enumerate(score)])
    width = F.greatest(F.lit(1), F.floor(0.75 * F.pow(F.col("_n"), F.lit(1 / 3))))
    running = scores.select(*by, "_pos", "_n", width.alias("_l"), *[
        F.sum(f"_u{i}").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_s{i}") for i in terms])
    earlier = running.select(*by, (F.col("_pos") + F.col("_l") + 1).alias("_pos"),
                             *[F.col(f"_s{i}").alias(f"_p{i}") for i in terms])
    inner = running.join(earlier, [*by, "_pos"], "left").select(
        *by, "_l", *[(F.col(f"_s{i}") - F.coalesce(f"_p{i}", F.lit(0.0))).alias(f"_v{i}") for i in terms])
    tail = running.where((F.col("_pos") >= F.col("_n") - F.col("_l")) & (F.col("_pos") < F.col("_n"))).select(
        *by, "_l", *[F.col(f"_s{i}").alias(f"_v{i}") for i in terms])
    moving = inner.unionByName(tail)
    sums = complete_moments(moving, [f"_v{i}" for i in terms], series=[*by, "_l"]).select(
        *by, F.col("_l").cast("int").alias("lags"), F.col("n").alias("moving_n"), F.col("means").alias("moving_means"), F.col("cross").alias("moving_cross"))
    joined = attach(grams, sums, by)
    fields = [f for f in grams.schema.fields if f.name in by]
    schema = T.StructType(fields + T.StructType.fromDDL(
        "term string, coef double, se_hac double, z double, p_hac double, lags int, n long").fields)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                n, means, cov = unpack(row.n, row.means, row.cross)
                k = len(features)
                fit = solve_block(n, means, cov, range(k), k)
                m, centre, spread = unpack(row.moving_n, row.moving_means, row.moving_cross)
                middle = m * (spread + np.outer(centre, centre)) / (row.lags + 1)
                bread = np.zeros((k + 1, k + 1))
                bread[0, 0], bread[1:, 1:] = 1 / n, fit["unscaled"]
                back = np.eye(k + 1)
                back[0, 1:] = -means[:k]
                var = np.diag(back @ bread @ middle @ bread @ back.T)
                with np.errstate(divide="ignore", invalid="ignore"):
                    se = np.sqrt(np.clip(var, 0, None))
                    z = fit["coef"] / se
                p = normal_two_sided(z)
                for i, term in enumerate(["const", *features]):
                    out.append((*(getattr(row, c) for c in by), term, fit["coef"][i], se[i], z[i], p[i],
                                int(row.lags), n))
            yield pd.DataFrame(out, columns=schema.names)

    solved = joined.mapInPandas(solve, schema)
    return solved.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("coef", "se_hac", "z", "p_hac")})


def variance_inflation(coefs: DataFrame, *, series=None, limit: float = 10.0) -> DataFrame:
    return coefs.where(F.col("term") != "const").select(
        *keys(series), F.col("term").alias("feature"), "vif", (F.col("vif") > limit).alias("is_high"))


def robustness_report(df: DataFrame, target: str, features: Sequence[str], weather: Sequence[str], *,
                      date: str = "date", series=None) -> DataFrame:
    """Diagnostics of the level, difference and lagged-target models in long form: (metric, value).

    The day rows are written once, since every model passes over them.
    """
    by = keys(series)
    df = durable(df.dropna(subset=[target, *features]).select(*by, date, target, *features))
    coefs, fitted = with_residuals(df, target, features, series=series)
    level_dw = durbin_watson(fitted, date=date, series=series)
    fd, fd_dw = first_difference_fit(df, target, features, date=date, series=series)
    ldv, ldv_dw = lagged_target_fit(df, target, features, date=date, series=series)
    reduced = ols(df, target, features, series=series,
                  models={"full": list(features), "reduced": [f for f in features if f not in set(weather)]})
    hac = newey_west(df, target, features, date=date, series=series)
    last = f"{target}_lag1"
    out = None
    for name, table, value in (
        ("dw_levels", level_dw, F.col("dw")),
        ("dw_difference", fd_dw, F.col("dw")),
        ("dw_lagged_target", ldv_dw, F.col("dw")),
        ("r2_levels", coefs.where("term = 'const'"), F.col("r2")),
        ("r2_difference", fd.where("term = 'const'"), F.col("r2")),
        ("r2_lagged_target", ldv.where("term = 'const'"), F.col("r2")),
        ("lagged_target_coef", ldv.where(F.col("term") == last), F.col("coef")),
        ("lagged_target_p", ldv.where(F.col("term") == last), F.col("p")),
        ("r2_without_weather", reduced.where("term = 'const' and model = 'reduced'"), F.col("r2")),
        ("hac_significant", hac.groupBy(*by).agg(F.count_if(F.col("p_hac") < 0.05).alias("v")), F.col("v")),
        ("hac_lags", hac.where("term = 'const'"), F.col("lags")),
    ):
        one = table.select(*by, F.lit(name).alias("metric"), value.cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def _adf_one(y: np.ndarray) -> tuple[float, float, int, int]:
    """ADF statistic with constant: lag by AIC on a common sample, then a refit on the sample that lag allows."""
    step = np.diff(y)
    top = min(int(math.ceil(12.0 * (len(y) / 100.0) ** 0.25)), len(y) // 2 - 2)

    def fit(lags: int, start: int) -> tuple[float, float]:
        dep = step[start:]
        cols = [y[start:-1], *[step[start - j:len(step) - j] for j in range(1, lags + 1)], np.ones(len(dep))]
        x = np.column_stack(cols)
        beta, _, rank, _ = np.linalg.lstsq(x, dep, rcond=None)
        rss = float(np.sum((dep - x @ beta) ** 2))
        n = len(dep)
        aic = n * (math.log(2 * math.pi * rss / n) + 1) + 2 * rank if rss > 0 else -math.inf
        spread = np.linalg.pinv(x.T @ x)[0, 0] * rss / max(n - rank, 1)
        return aic, beta[0] / math.sqrt(spread) if spread > 0 else math.nan

    lag = min(range(top + 1), key=lambda k: fit(k, top)[0])
    tau = fit(lag, lag)[1]
    return tau, mackinnon_p(tau), lag, len(step) - lag


def adf_test(days: DataFrame, values: Sequence[str], *, date: str = "date", series=None, min_rows: int = 20) -> DataFrame:
    """Augmented Dickey-Fuller per series and column; shorter series give no row, a constant one has no statistic and says so in ``note``.

    The lag search needs the ordered series itself, so each one is handed to a task as a whole: the input must be
    day-grain, where a group is no longer than its calendar.
    """
    by = keys(series)
    long = days.select(*by, date, F.inline(F.array(*[
        F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values]))).dropna(subset=["value"])
    fields = [f for f in days.schema.fields if f.name in by]
    schema = T.StructType(fields + T.StructType.fromDDL(
        "name string, adf double, p double, lag int, n_obs long, stationary boolean, note string").fields)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < min_rows:
            return pd.DataFrame(columns=schema.names)
        first = pdf.iloc[0]
        if pdf["value"].nunique() < 2:
            return pd.DataFrame([(*(first[c] for c in by), first["name"], None, None, None, len(pdf), None, "constant")], columns=schema.names)
        y = pdf.sort_values(date)["value"].to_numpy()
        tau, p, lag, n = _adf_one(y)
        return pd.DataFrame([(*(first[c] for c in by), first["name"], tau, p, lag, n, p < 0.05, None)], columns=schema.names)

    return long.groupBy(*by, "name").applyInPandas(test, schema)
