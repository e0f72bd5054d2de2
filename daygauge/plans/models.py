"""Regressions, their diagnostics, and the forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygauge.operators import forest as fo
from daygauge.operators import gap as gp
from daygauge.operators import regression as rg
from daygauge.operators import robustness as rb
from daygauge.operators.features import WEATHER_FEATURES
from daygauge.plans.registry import query, r6
from daygauge.plans.roles import (FEATURES, FEW, INTENT, count_days, day_table, landed_days, model_table, sql_days, sql_features, sql_ols,
                                  sql_predicted, sql_t_p, sql_terms)
from daygauge.session import durable
from daygauge.sources import sinks as sk

NO_WEATHER = [f for f in FEATURES if f not in WEATHER_FEATURES]
FEW_ROWS = f"few AS (SELECT * FROM days WHERE {INTENT} IS NOT NULL AND wind IS NOT NULL AND temp IS NOT NULL)"
SITE_FIT = f"{sql_days(True)}, {FEW_ROWS}, {sql_ols('few', 'count', FEW, ['site'])}"
ONE_FIT = f"{sql_days()}, {FEW_ROWS}, {sql_ols('few', 'count', FEW)}"
FULL_FIT = f"{sql_features()}, {sql_ols('model', 'count', FEATURES)}"


def site_rows(spark, sf) -> DataFrame:
    """Day rows of the site models, written once: the raw tables are read a single time however often a model passes."""
    return durable(day_table(spark, sf, "site").dropna(subset=["count", *FEW]).select("site", "date", "count", *FEW))


def full_fit(spark, sf) -> DataFrame:
    return rg.ols(model_table(spark, sf), "count", FEATURES)


@query("ols_by_site", f"""WITH {SITE_FIT}, terms AS ({sql_terms(FEW, by=['site'])})
SELECT site, term, coef, se, t, {sql_t_p('t', 'df')} AS p, n, r2, adj_r2 FROM terms""", r6("coef", "se", "t", "p", "r2", "adj_r2"))
def _(spark, sf):
    return rg.ols(site_rows(spark, sf), "count", FEW, series="site").select("site", "term", "coef", "se", "t", "p", "n", "r2", "adj_r2")


@query("coefficient_table", f"""WITH {FULL_FIT}, terms AS ({sql_terms(FEATURES)}), tested AS (SELECT *, {sql_t_p('t', 'df')} AS p FROM terms)
SELECT 'full' AS model, term, coef, p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars, r2, adj_r2, n FROM tested""",
       {"coef": 5, "p": 6, "r2": 6, "adj_r2": 6})
def _(spark, sf):
    return rg.coefficient_table(full_fit(spark, sf))


@query("significant_predictors", f"""WITH {SITE_FIT}, terms AS ({sql_terms(FEW, by=['site'])}), tested AS (SELECT *, {sql_t_p('t', 'df')} AS p FROM terms)
SELECT site, term, coef, p FROM tested WHERE p < 0.05""", r6("coef", "p"))
def _(spark, sf):
    return rg.significant_terms(rg.ols(site_rows(spark, sf), "count", FEW, series="site")).select("site", "term", "coef", "p")


@query("ols_predictions", f"WITH {SITE_FIT} SELECT site, date, count, {sql_predicted(FEW)} AS predicted FROM few JOIN fit USING (site)", r6("predicted"))
def _(spark, sf):
    rows = site_rows(spark, sf)
    coefs = rg.ols(rows, "count", FEW, series="site")
    return rg.predict(rows, coefs, FEW, series="site").select("site", "date", "count", "predicted")


SD = ", ".join(f"stddev_samp({c}) AS s{i}" for i, c in enumerate(FEW, start=1))
BETAS = "\nUNION ALL ".join(f"SELECT site, '{c}' AS term, b{i} * s{i} / sy AS beta_std FROM fit JOIN sd USING (site)" for i, c in enumerate(FEW, start=1))


@query("standardised_betas", f"""WITH {SITE_FIT}, sd AS (SELECT site, {SD}, stddev_samp(count) AS sy FROM few GROUP BY site), b AS ({BETAS})
SELECT site, 'full' AS model, term, beta_std, abs(beta_std) AS abs_beta, row_number() OVER (PARTITION BY site ORDER BY abs(beta_std) DESC, term) AS rank FROM b""",
       r6("beta_std", "abs_beta"))
def _(spark, sf):
    betas = rg.ranked_betas(rg.ols(site_rows(spark, sf), "count", FEW, series="site"), series="site")
    return betas.withColumn("rank", F.col("rank").cast("long"))


@query("zscore_regression", f"""WITH {SITE_FIT}, sd AS (SELECT site, {SD}, stddev_samp(count) AS sy FROM few GROUP BY site)
SELECT site, 'full' AS model, b4 * s4 / sy AS beta_std FROM fit JOIN sd USING (site)""", r6("beta_std"))
def _(spark, sf):
    return rg.standardised_beta(rg.ols(site_rows(spark, sf), "count", FEW, series="site"), "wind", series="site")


@query("constant_feature_fit", f"""WITH {sql_days(True)}, {FEW_ROWS}, {sql_ols('few', 'count', [INTENT, 'temp'], ['site'])}
SELECT site, n, CAST(3 AS INT) AS n_features, CAST(2 AS INT) AS rank, 1 - sse / sst AS r2, 1 - (sse / sst) * (n - 1) / (n - 3) AS adj_r2, CAST(NULL AS DOUBLE) AS snow_beta FROM fit""",
       r6("r2", "adj_r2"))
def _(spark, sf):
    rows = site_rows(spark, sf).withColumn("snow", F.lit(0.0))
    coefs = rg.ols(rows, "count", [INTENT, "temp", "snow"], series="site")
    beta = rg.standardised_beta(coefs, "snow", series="site").select("site", F.col("beta_std").alias("snow_beta"))
    return rg.fit_summary(coefs, series="site").select("site", "n", "n_features", "rank", "r2", "adj_r2").join(beta, "site")


@query("effect_size", f"""WITH {SITE_FIT}, f AS (SELECT site, 1 - sse / sst AS r2, (1 - sse / sst) / (sse / sst) AS f2 FROM fit)
SELECT *, CASE WHEN f2 >= 0.35 THEN 'large' WHEN f2 >= 0.15 THEN 'medium' WHEN f2 >= 0.02 THEN 'small' ELSE 'negligible' END AS magnitude FROM f""", r6("r2", "f2"))
def _(spark, sf):
    fits = rg.fit_summary(rg.ols(site_rows(spark, sf), "count", FEW, series="site"), series="site")
    return rg.effect_sizes(fits).select("site", "r2", "f2", "magnitude")


RESIDUALS = f"res AS (SELECT site, date, count - ({sql_predicted(FEW)}) AS e FROM few JOIN fit USING (site))"
SQL_DW = "dw AS (SELECT site, sum(d * d) / sum(e * e) AS dw FROM (SELECT site, e, e - lag(e) OVER (PARTITION BY site ORDER BY date) AS d FROM res) GROUP BY site)"


@query("durbin_watson", f"WITH {SITE_FIT}, {RESIDUALS}, {SQL_DW} SELECT site, dw, dw BETWEEN 1.5 AND 2.5 AS dw_clean FROM dw", r6("dw"))
def _(spark, sf):
    _, rows = rb.with_residuals(site_rows(spark, sf), "count", FEW, series="site")
    return rb.durbin_watson(rows, series="site")


VIFS = "\nUNION ALL ".join(f"SELECT '{c}' AS feature, v{i} * var_pop({c}) * count(*) AS vif FROM model, fit GROUP BY v{i}" for i, c in enumerate(FEATURES, start=1))


@query("variance_inflation", f"WITH {FULL_FIT}, v AS ({VIFS}) SELECT feature, vif, vif > 10 AS is_high FROM v", {"vif": 5})
def _(spark, sf):
    return rb.variance_inflation(full_fit(spark, sf))


def sql_hac(by: str = "site") -> str:
    """Meat of the sandwich term by term: the autocovariances of the scores with Bartlett weights (the textbook form)."""
    k = len(FEW)
    scores = ", ".join(["e AS u0", *[f"e * {c} AS u{i}" for i, c in enumerate(FEW, start=1)]])
    meat = ", ".join(f"sum(w * (x.u{i} * y.u{j} + CASE WHEN h > 0 THEN y.u{i} * x.u{j} ELSE 0 END)) AS s{i}_{j}" for i in range(k + 1) for j in range(i, k + 1))
    return f"""res AS (SELECT site, row_number() OVER (PARTITION BY site ORDER BY date) AS i, {', '.join(FEW)}, count - ({sql_predicted(FEW)}) AS e, n FROM few JOIN fit USING (site)),
u AS (SELECT site, i, greatest(1, CAST(floor(0.75 * pow(n, 1.0 / 3)) AS INT)) AS l, {scores} FROM res),
lags AS (SELECT site, l, unnest(range(0, l + 1)) AS h FROM (SELECT DISTINCT site, l FROM u)),
meat AS (SELECT x.site, any_value(x.l) AS l, {meat.replace('w *', '(1 - h / (lags.l + 1.0::DOUBLE)) *')}
  FROM u x JOIN lags ON lags.site = x.site JOIN u y ON y.site = x.site AND y.i = x.i - lags.h GROUP BY x.site)"""


def sql_hac_terms() -> str:
    """Standard errors from unscaled inverse (sweep cells), meat and means."""
    k = len(FEW)

    def inv(i: int, j: int) -> str:
        cell = f"-a{min(i, j) - 1}_{max(i, j) - 1}"
        if i and j:
            return f"({cell})"
        if i == 0 and j == 0:
            return "v0"
        p = max(i, j)
        return "(" + " ".join(f"+ a{min(p, q) - 1}_{max(p, q) - 1} * m{q - 1}" for q in range(1, k + 1)) + ")"

    def meat(i: int, j: int) -> str:
        return f"s{min(i, j)}_{max(i, j)}"

    rows = []
    for t, term in enumerate(["const", *FEW]):
        var = " + ".join(f"{inv(t, i)} * {meat(i, j)} * {inv(j, t)}" for i in range(k + 1) for j in range(k + 1))
        rows.append(f"SELECT site, '{term}' AS term, b{t} AS coef, sqrt({var}) AS se_hac, CAST(l AS INT) AS lags, n FROM fit JOIN fit_s{k} USING (site, n) JOIN meat USING (site)")
    return "\nUNION ALL ".join(rows)


# The sweep's last matrix and the fit share their means, so only one side may carry them.
HAC_SQL = sql_hac_terms().replace("FROM fit JOIN", f"FROM (SELECT site, n, v0, {', '.join(f'b{i}' for i in range(len(FEW) + 1))} FROM fit) JOIN")


@query("newey_west", f"WITH {SITE_FIT}, {sql_hac()} {HAC_SQL}", {"coef": 6, "se_hac": 5})
def _(spark, sf):
    return rb.newey_west(site_rows(spark, sf), "count", FEW, series="site").select("site", "term", "coef", "se_hac", "lags", "n")


@query("newey_west_tests")
def _(spark, sf):
    return rb.newey_west(durable(model_table(spark, sf)), "count", FEATURES)


FD_COLUMNS = ", ".join(f"{c} - lag({c}) OVER w AS {c}" for c in ["count", *FEW])
FD_ROWS = f"""changed AS (SELECT * FROM (SELECT site, date, {FD_COLUMNS} FROM few WINDOW w AS (PARTITION BY site ORDER BY date)) WHERE count IS NOT NULL),
{sql_ols('changed', 'count', FEW, ['site'])}, res AS (SELECT site, date, count - ({sql_predicted(FEW)}) AS e FROM changed JOIN fit USING (site)), {SQL_DW}"""


@query("first_difference_model", f"WITH {sql_days(True)}, {FEW_ROWS}, {FD_ROWS} SELECT site, n, 1 - sse / sst AS r2, dw, dw BETWEEN 1.5 AND 2.5 AS dw_clean FROM fit JOIN dw USING (site)",
       r6("r2", "dw"))
def _(spark, sf):
    coefs, dw = rb.first_difference_fit(site_rows(spark, sf), "count", FEW, series="site")
    return rg.fit_summary(coefs, series="site").select("site", "n", "r2").join(dw, "site")


LDV = [*FEW, "count_lag1"]
LDV_ROWS = f"""lagged AS (SELECT * FROM (SELECT *, lag(count) OVER (PARTITION BY site ORDER BY date) AS count_lag1 FROM few) WHERE count_lag1 IS NOT NULL),
{sql_ols('lagged', 'count', LDV, ['site'])}, res AS (SELECT site, date, count - ({sql_predicted(LDV)}) AS e FROM lagged JOIN fit USING (site)), {SQL_DW}, terms AS ({sql_terms(LDV, by=['site'])})"""


@query("lagged_target_model", f"""WITH {sql_days(True)}, {FEW_ROWS}, {LDV_ROWS} SELECT site, n, r2, coef AS lag_coef, {sql_t_p('t', 'df')} AS lag_p, dw
FROM terms JOIN dw USING (site) WHERE term = 'count_lag1'""", r6("r2", "lag_coef", "lag_p", "dw"))
def _(spark, sf):
    coefs, dw = rb.lagged_target_fit(site_rows(spark, sf), "count", FEW, series="site")
    last = coefs.where("term = 'count_lag1'").select("site", "n", "r2", F.col("coef").alias("lag_coef"), F.col("p").alias("lag_p"))
    return last.join(dw.select("site", "dw"), "site")


@query("weather_ablation", f"""WITH {FULL_FIT}, {sql_ols('model', 'count', NO_WEATHER, name='red')}
SELECT fit.n, 1 - fit.sse / fit.sst AS r2_full, 1 - red.sse / red.sst AS r2_reduced, red.sse / red.sst - fit.sse / fit.sst AS lift FROM fit, red""",
       r6("r2_full", "r2_reduced", "lift"))
def _(spark, sf):
    return rg.ablation(model_table(spark, sf), "count", FEATURES, WEATHER_FEATURES)


SEASON_FEATURES = [INTENT, f"{INTENT}_roll7", "precip", "temp", "wind", "is_weekend_or_holiday"]
SEASON_KEPT = [f for f in SEASON_FEATURES if f not in WEATHER_FEATURES]
SEASONS = f"""{sql_features(True)}, seasons AS (SELECT *, CASE WHEN month IN (6, 7, 8) THEN 'summer' ELSE 'winter' END AS season FROM model WHERE month IN (6, 7, 8, 12, 1, 2)),
{sql_ols('seasons', 'count', SEASON_FEATURES, ['site', 'season'])}, {sql_ols('seasons', 'count', SEASON_KEPT, ['site', 'season'], name='red')},
lifts AS (SELECT site, season, fit.n, 1 - fit.sse / fit.sst AS r2_full, 1 - red.sse / red.sst AS r2_reduced, red.sse / red.sst - fit.sse / fit.sst AS lift
  FROM fit JOIN red USING (site, season) WHERE fit.n >= 15)"""


def season_lifts(spark, sf) -> DataFrame:
    return gp.seasonal_lift(model_table(spark, sf, "site"), "count", SEASON_FEATURES, WEATHER_FEATURES, series="site")


@query("seasonal_sensitivity", f"WITH {SEASONS} SELECT * FROM lifts", r6("r2_full", "r2_reduced", "lift"))
def _(spark, sf):
    return season_lifts(spark, sf)


@query("seasonal_ratio", f"""WITH {SEASONS}, p AS (SELECT site, coalesce(max(lift) FILTER (WHERE season = 'summer'), 0) AS summer_lift, coalesce(max(lift) FILTER (WHERE season = 'winter'), 0) AS winter_lift FROM lifts GROUP BY site)
SELECT *, CASE WHEN summer_lift > 0 THEN winter_lift / summer_lift ELSE 'Infinity'::DOUBLE END AS ratio FROM p""", r6("summer_lift", "winter_lift", "ratio"))
def _(spark, sf):
    return gp.season_ratio(season_lifts(spark, sf), series="site")


HOLDOUT = f"""{sql_days(True)}, {FEW_ROWS}, split AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY date) <= floor(count(*) OVER (PARTITION BY site) * 0.8) AS is_train FROM few),
train AS (SELECT * FROM split WHERE is_train), {sql_ols('train', 'count', FEW, ['site'])},
held AS (SELECT site, count AS y, {sql_predicted(FEW)} AS p FROM split JOIN fit USING (site) WHERE NOT is_train)"""


@query("holdout_validation", f"""WITH {HOLDOUT} SELECT site, any_value(n) AS train_n, count(*) AS holdout_n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
1 - avg((y - p) * (y - p)) / var_pop(y) AS r2 FROM held JOIN (SELECT site, n FROM fit) USING (site) GROUP BY site""", r6("mae", "rmse", "r2"))
def _(spark, sf):
    return rg.holdout_scores(site_rows(spark, sf), "count", FEW, series="site")


@query("chronological_split", f"WITH {HOLDOUT} SELECT site, date, is_train FROM split")
def _(spark, sf):
    return rg.chronological_split(site_rows(spark, sf), series="site").select("site", "date", "is_train")


@query("contiguous_folds", f"WITH {sql_days(True)} SELECT site, date, CAST(ntile(5) OVER (PARTITION BY site ORDER BY date) - 1 AS INT) AS fold FROM days")
def _(spark, sf):
    return fo.contiguous_folds(count_days(spark, sf, "site"), 5, series="site").select("site", "date", "fold")


@query("quadratic_fit", f"""WITH {sql_days(True)}, q AS (SELECT site, count, temp AS x, temp * temp AS x2 FROM days), {sql_ols('q', 'count', ['x', 'x2'], ['site'])}
SELECT site, b2 AS a, b1 AS b, b0 AS c, -b1 / (2 * b2) AS vertex FROM fit""", {"a": 6, "b": 6, "c": 5, "vertex": 5})
def _(spark, sf):
    return rg.quadratic_vertex(day_table(spark, sf, "site"), "count", "temp", series="site")


@query("simple_regression", f"WITH {sql_days(True)} SELECT site, count(*) AS n, regr_slope(count, {INTENT}) AS slope, regr_intercept(count, {INTENT}) AS intercept, regr_r2(count, {INTENT}) AS r2 FROM days WHERE {INTENT} IS NOT NULL GROUP BY site",
       r6("slope", "intercept", "r2"))
def _(spark, sf):
    return rg.simple_regression(day_table(spark, sf, "site"), "count", INTENT, series="site")


@query("robustness_report")
def _(spark, sf):
    return rb.robustness_report(site_rows(spark, sf), "count", FEW, ["precip", "temp", "wind"], series="site")


# ---------------------------------------------------------------- forest

TREES, FOLD_TREES = 500, 100  # five fits of 500 trees take minutes on one machine, see the README


def forest_input(spark, sf) -> DataFrame:
    return fo.forest_rows(fo.contiguous_folds(model_table(spark, sf), 5), "count", FEATURES, keep=["date", "fold"])


@query("forest_scores")
def _(spark, sf):
    rows = durable(forest_input(spark, sf))
    return fo.train_scores(fo.fit_forest(rows, trees=TREES), rows)


@query("forest_cross_validation")
def _(spark, sf):
    return fo.fold_summary(fo.cross_validate(forest_input(spark, sf), trees=FOLD_TREES))


@query("forest_importance")
def _(spark, sf):
    return fo.impurity_importance(fo.fit_forest(forest_input(spark, sf), trees=TREES), FEATURES, spark)


@query("forest_permutation_importance")
def _(spark, sf):
    days = durable(model_table(spark, sf))
    model = fo.fit_forest(fo.forest_rows(days, "count", FEATURES), trees=TREES)
    return fo.permutation_importance(model, days, "count", FEATURES, order=["date"], repeats=10)


# ---------------------------------------------------------------- tables of results

METRICS = f"""metrics AS (SELECT 'level' AS model, 'r2' AS metric, 1 - sse / sst AS value FROM fit UNION ALL SELECT 'level', 'n', n FROM fit
UNION ALL SELECT 'line', 'r2', regr_r2(count, {INTENT}) FROM few)"""


@query("model_comparison", f"""WITH {ONE_FIT}, {METRICS} SELECT model, coalesce(max(CASE WHEN metric = 'r2' THEN printf('%.4f', value) END), '--') AS r2,
coalesce(max(CASE WHEN metric = 'n' THEN printf('%.4f', value) END), '--') AS n FROM metrics GROUP BY model""")
def _(spark, sf):
    rows = landed_days(spark, sf).dropna(subset=["count", *FEW])
    fit = rg.fit_summary(rg.ols(rows, "count", FEW)).withColumn("model", F.lit("level"))
    long = fit.select("model", F.inline(F.array(F.struct(F.lit("r2").alias("metric"), F.col("r2").alias("value")),
                                                F.struct(F.lit("n").alias("metric"), F.col("n").cast("double").alias("value")))))
    line = rg.simple_regression(rows, "count", INTENT).select(F.lit("line").alias("model"), F.lit("r2").alias("metric"), F.col("r2").alias("value"))
    return sk.model_comparison(long.unionByName(line), ["r2", "n"])


@query("key_metrics_table", f"""WITH {ONE_FIT} SELECT CAST(0 AS INT) AS position, 'Days' AS metric, format('{{:,}}', n) AS shown FROM fit
UNION ALL SELECT 1, 'R squared', printf('%.4f', 1 - sse / sst) FROM fit UNION ALL SELECT 2, 'Kind', 'level' FROM fit""")
def _(spark, sf):
    fit = rg.fit_summary(rg.ols(day_table(spark, sf), "count", FEW)).withColumn("kind", F.lit("level"))
    return sk.key_metrics(fit, {"n": "Days", "r2": "R squared", "kind": "Kind"})


@query("metrics_long", f"""WITH {SITE_FIT}, m AS (SELECT site, CAST(n AS DOUBLE) AS n, 1 - sse / sst AS r2, 1 - (sse / sst) * (n - 1) / (n - {len(FEW) + 1}) AS adj_r2 FROM fit)
SELECT 'sites' AS section, site AS series, CAST(position AS INT) AS position, metric, CASE metric WHEN 'n' THEN n WHEN 'r2' THEN r2 ELSE adj_r2 END AS value
FROM m, (VALUES (0, 'n'), (1, 'r2'), (2, 'adj_r2')) AS v(position, metric)""", r6("value"))
def _(spark, sf):
    fits = rg.fit_summary(rg.ols(site_rows(spark, sf), "count", FEW, series="site"), series="site")
    return sk.metric_rows(fits, "sites", ["n", "r2", "adj_r2"], series="site")
