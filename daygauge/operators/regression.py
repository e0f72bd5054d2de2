"""Least squares as one grouped aggregation and a k by k solve.

Spark reduces any number of rows to centred cross-products, one short row per series (``moments`` merges the matrices of
tasks stably). Every model over the same rows (all features, without the
weather features, each variance inflation factor, the one-regressor baseline) is then a solve on sub-blocks of that one
matrix; no model needs a second pass. The solve runs per row of the reduced table, on executors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygauge.functions.distributions import t_two_sided
from daygauge.functions.scalars import effect_band, effect_size, pearson, safe_divide, stars
from daygauge.operators.daily import attach, keys
from daygauge.operators.moments import complete_moments

TERM_FIELDS = "model string, term string, coef double, se double, t double, p double, beta_std double, vif double"
FIT_FIELDS = ("n long, n_features int, rank int, df_resid double, r2 double, adj_r2 double, sse double, sst double")


def gram(df: DataFrame, target: str, features: Sequence[str], *, series=None) -> DataFrame:
    """One row per series: n, means and the upper triangle of centred cross-products / n of complete rows.

    Column order inside the arrays is features, then target. Only one matrix per task and series is shuffled, whatever one
    series weighs (``moments``).
    """
    return complete_moments(df, [*features, target], series=series)


def solve_block(n: int, means: np.ndarray, cov: np.ndarray, xs: Sequence[int], y: int) -> dict:
    """Regression of column y on columns xs with intercept, from means and centred covariances.

    The block is scaled to a correlation matrix first; a constant column keeps coefficient 0 and does not count
    towards the rank, which is what a pseudo-inverse fit gives.
    """
    xs = list(xs)
    sd = np.sqrt(np.clip(np.diag(cov)[xs], 0, None))
    # Rounding leaves a constant column with a spread of about eps times its level.
    live = sd > 1e-12 * np.maximum(np.abs(means[xs]), 1e-300)
    scale = np.where(live, sd, 1.0)
    block = np.where(np.outer(live, live), cov[np.ix_(xs, xs)] / np.outer(scale, scale), 0.0)
    inverse = np.linalg.pinv(block, rcond=1e-10, hermitian=True) if xs else block
    rank = int(np.linalg.matrix_rank(block, tol=1e-10 * max(len(xs), 1), hermitian=True)) if xs else 0
    with_y = np.where(live, cov[xs, y] / scale, 0.0)
    slopes = inverse @ with_y / scale
    sst = n * cov[y, y]
    sse = max(0.0, n * (cov[y, y] - with_y @ inverse @ with_y))
    df = n - 1 - rank
    s2 = sse / df if df > 0 else np.nan
    unscaled = inverse / np.outer(scale, scale) / n
    centre = means[xs]
    r2 = 1 - sse / sst if sst > 0 else np.nan
    return {
        "coef": np.concatenate([[means[y] - slopes @ centre], slopes]),
        "var": s2 * np.concatenate([[1 / n + centre @ unscaled @ centre], np.diag(unscaled)]),
        "unscaled": unscaled, "sd": np.where(live, sd, 0.0), "inverse": inverse, "live": live,
        "n": n, "rank": rank, "df": df, "sse": sse, "sst": sst, "r2": r2,
        "adj_r2": 1 - (1 - r2) * (n - 1) / df if df > 0 else np.nan,
    }


def unpack(n, means, cross) -> tuple[int, np.ndarray, np.ndarray]:
    means = np.asarray(means, dtype=float)
    k = len(means)
    cov = np.zeros((k, k))
    upper = np.triu_indices(k)
    cov[upper] = cross
    return int(n), means, cov + np.triu(cov, 1).T


def fit_models(grams: DataFrame, features: Sequence[str], models: Mapping[str, Sequence[str]] | None = None,
               *, series=None) -> DataFrame:
    """Coefficient table, one row per series, model and term, with the fit figures repeated on each row.

    ``models`` maps a model name to its subset of ``features``; all are solved from the same matrix.
    """
    by, features = keys(series), list(features)
    models = {m: list(f) for m, f in (models or {"full": features}).items()}
    order = {c: i for i, c in enumerate(features)}
    fields = [f for f in grams.schema.fields if f.name in by]
    schema = T.StructType(fields + T.StructType.fromDDL(f"{TERM_FIELDS}, {FIT_FIELDS}").fields)
    columns = schema.names

    def solve(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                n, means, cov = unpack(row.n, row.means, row.cross)
                group = tuple(getattr(row, c) for c in by)
                for name, used in models.items():
                    xs = [order[c] for c in used]
                    fit = solve_block(n, means, cov, xs, len(features))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        se = np.sqrt(fit["var"])
                        t = fit["coef"] / se
                        p = t_two_sided(t, fit["df"])
                        sd_y = np.sqrt(cov[-1, -1])
                        beta = [None, *(fit["coef"][1:] * fit["sd"] / sd_y)]
                    vif = [None, *np.where(fit["live"], np.diag(fit["inverse"]), np.nan)]
                    for i, term in enumerate(["const", *used]):
                        rows.append((*group, name, term, fit["coef"][i], se[i], t[i], p[i], beta[i], vif[i], n,
                                     len(used), fit["rank"], float(fit["df"]), fit["r2"], fit["adj_r2"], fit["sse"],
                                     fit["sst"]))
            yield pd.DataFrame(rows, columns=columns)

    out = grams.mapInPandas(solve, schema)
    doubles = [f.name for f in schema.fields if f.dataType == T.DoubleType() and f.name not in by]
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def ols(df: DataFrame, target: str, features: Sequence[str], *, series=None,
        models: Mapping[str, Sequence[str]] | None = None, min_rows: int = 0) -> DataFrame:
    """Ordinary least squares with intercept on complete rows."""
    grams = gram(df, target, features, series=series)
    return fit_models(grams.where(F.col("n") >= max(min_rows, 1)), features, models, series=series)


def fit_summary(coefs: DataFrame, *, series=None) -> DataFrame:
    """One row per series and model."""
    names = [f.split()[0] for f in FIT_FIELDS.split(", ")]
    return coefs.where(F.col("term") == "const").select(*keys(series), "model", *names)


def coefficient_table(coefs: DataFrame, *, series=None) -> DataFrame:
    """Term, coefficient, p and stars, with R squared, adjusted R squared and N."""
    return coefs.select(*keys(series), "model", "term", "coef", "p", stars("p").alias("stars"), "r2", "adj_r2", "n")


def significant_terms(coefs: DataFrame, level: float = 0.05) -> DataFrame:
    return coefs.where(F.col("p") < level)


def standardised_beta(coefs: DataFrame, term: str, *, series=None, min_rows: int = 31) -> DataFrame:
    """Coefficient of the regression on z-scores; NULL as soon as any feature is constant, since then no row survives
    the division by its spread."""
    by = keys(series)
    return coefs.where(F.col("term") != "const").groupBy(*by, "model").agg(
        F.when(~F.bool_or(F.coalesce(F.col("beta_std") == 0, F.lit(True)) & F.col("vif").isNull())
               & (F.max("n") >= min_rows),
               F.max(F.when(F.col("term") == term, F.col("beta_std")))).alias("beta_std"))


def ranked_betas(coefs: DataFrame, *, series=None) -> DataFrame:
    by = keys(series)
    w = Window.partitionBy(*by, "model").orderBy(F.abs("beta_std").desc(), "term")
    return (coefs.where(F.col("term") != "const")
            .select(*by, "model", "term", "beta_std", F.abs("beta_std").alias("abs_beta"), F.row_number().over(w).alias("rank")))


def effect_sizes(fits: DataFrame) -> DataFrame:
    return fits.withColumn("f2", effect_size("r2")).withColumn("magnitude", effect_band("f2"))


def predict(df: DataFrame, coefs: DataFrame, features: Sequence[str], *, series=None, model: str = "full",
            out: str = "predicted") -> DataFrame:
    """Fitted value column; the coefficients travel as one short row per series."""
    by = keys(series)
    terms = ["const", *features]
    picked = coefs.where(F.col("model") == model)
    wide = picked.groupBy(*by).agg(
        *[F.max(F.when(F.col("term") == t, F.col("coef"))).alias(f"_b{i}") for i, t in enumerate(terms)])
    joined = attach(df, wide, by)
    total = F.col("_b0")
    for i, c in enumerate(features, start=1):
        total = total + F.col(f"_b{i}") * F.col(c)
    return joined.withColumn(out, total).drop(*[f"_b{i}" for i in range(len(terms))])


def ablation(df: DataFrame, target: str, features: Sequence[str], without: Sequence[str], *, series=None,
             min_rows: int = 0) -> DataFrame:
    """R squared with and without a feature set, and the difference."""
    by = keys(series)
    kept = [f for f in features if f not in set(without)]
    coefs = ols(df, target, features, series=series, models={"full": features, "reduced": kept}, min_rows=min_rows)
    fits = fit_summary(coefs, series=series)
    out = fits.groupBy(*by).agg(
        F.max("n").alias("n"), F.max(F.when(F.col("model") == "full", F.col("r2"))).alias("r2_full"),
        F.max(F.when(F.col("model") == "reduced", F.col("r2"))).alias("r2_reduced"))
    return out.withColumn("lift", F.col("r2_full") - F.col("r2_reduced"))


def chronological_split(df: DataFrame, *, date: str = "date", series=None, train: float = 0.8) -> DataFrame:
    """``is_train``: the first int(n * train) rows of each series by date."""
    by = keys(series)
    w = Window.partitionBy(*by).orderBy(date)
    n = F.count("*").over(Window.partitionBy(*by))
    return df.withColumn("is_train", F.row_number().over(w) <= F.floor(n * F.lit(train)))


def holdout_scores(df: DataFrame, target: str, features: Sequence[str], *, date: str = "date", series=None,
                   train: float = 0.8) -> DataFrame:
    """Fit on the early part, MAE, RMSE and R squared on the late part."""
    by = keys(series)
    rows = chronological_split(df.dropna(subset=[target, *features]), date=date, series=series, train=train)
    coefs = ols(rows.where("is_train"), target, features, series=series)
    scored = predict(rows, coefs, features, series=series)
    err = F.when(~F.col("is_train"), F.col(target) - F.col("predicted"))
    held = F.when(~F.col("is_train"), F.col(target))
    out = scored.groupBy(*by).agg(
        F.count_if("is_train").alias("train_n"), F.count_if(~F.col("is_train")).alias("holdout_n"),
        F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"), F.var_pop(held).alias("var"))
    return out.select(*by, "train_n", "holdout_n", "mae", F.sqrt("mse").alias("rmse"),
                      (1 - safe_divide("mse", "var")).alias("r2"))


def simple_regression(df: DataFrame, target: str, feature: str, *, series=None) -> DataFrame:
    """One regressor: slope, intercept and R squared by built-in aggregates."""
    rows = df.dropna(subset=[target, feature])
    r = pearson(target, feature)
    return rows.groupBy(*keys(series)).agg(
        F.count("*").alias("n"),
        F.regr_slope(target, feature).alias("slope"), F.regr_intercept(target, feature).alias("intercept"),
        (r * r).alias("r2"))


def quadratic_vertex(df: DataFrame, target: str, feature: str, *, series=None) -> DataFrame:
    """Second-order fit and the abscissa of its extremum."""
    by = keys(series)
    rows = df.select(*by, target, F.col(feature).cast("double").alias("x"), F.pow(F.col(feature), F.lit(2)).alias("x2"))
    coefs = ols(rows, target, ["x", "x2"], series=series)

    def coef(t: str):
        return F.max(F.when(F.col("term") == t, F.col("coef")))

    out = coefs.groupBy(*by).agg(coef("x2").alias("a"), coef("x").alias("b"), coef("const").alias("c"))
    return out.withColumn("vertex", safe_divide(-F.col("b"), 2 * F.col("a")))
