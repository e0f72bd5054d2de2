"""Correlation, rank, distribution and stationarity tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygauge.functions.scalars import contains_any, pearson
from daygauge.operators import association as asc
from daygauge.operators import daily as dl
from daygauge.operators import quality as ql
from daygauge.operators import robustness as rb
from daygauge.operators import sites as st
from daygauge.plans.registry import query, r6
from daygauge.plans.roles import (ANSWERS, HOURS, INTENT, READINGS, TEXTS, WORDS, answers, count_days, day_table, feature_table,
                                  hours, readings, sql_any, sql_corr_p, sql_days, sql_rank, sql_features, table, texts)

CCF_LAGS = range(-3, 8)


def sql_shift(column: str, k: int, window: str) -> str:
    return f"lag({column}, {k}) OVER ({window})" if k >= 0 else f"lead({column}, {-k}) OVER ({window})"


def sql_lag_rows(source: str, y: str, x: str, lags, by: str = "") -> str:
    key, part, group = (f"{by}, ", f"PARTITION BY {by} ", f" GROUP BY {by}") if by else ("", "", "")
    shifted = ", ".join(f"{sql_shift(x, k, part + 'ORDER BY date')} AS x{i}" for i, k in enumerate(lags))
    rows = "\nUNION ALL ".join(f"SELECT {key}CAST({k} AS INT) AS lag, corr({y}, x{i}) AS r, count(*) FILTER (WHERE {y} IS NOT NULL AND x{i} IS NOT NULL) AS n FROM shifted{group}"
                               for i, k in enumerate(lags))
    return f"shifted AS (SELECT {key}date, {y}, {shifted} FROM {source}), ccf AS ({rows})"


@query("lag_correlation_table", f"WITH {sql_days()}, {sql_lag_rows('days', 'count', INTENT, range(8))} SELECT * FROM ccf", r6("r"))
def _(spark, sf):
    return asc.lag_correlations(day_table(spark, sf), "count", INTENT, range(8))


@query("lag_two_by_day_kind", f"""WITH {sql_features()} SELECT CASE WHEN is_weekend_or_holiday = 1 THEN 'off' ELSE 'work' END AS kind,
corr(count, {INTENT}_lag2) AS r, count(*) AS n FROM features GROUP BY 1""", r6("r"))
def _(spark, sf):
    rows = feature_table(spark, sf)
    kind = F.when(F.col("is_weekend_or_holiday") == 1, "off").otherwise("work").alias("kind")
    return rows.groupBy(kind).agg(pearson("count", f"{INTENT}_lag2").alias("r"), F.count("*").alias("n"))


@query("site_lag_correlations", f"WITH {sql_days(True)}, {sql_lag_rows('days', 'count', INTENT, CCF_LAGS, 'site')} SELECT * FROM ccf", r6("r"))
def _(spark, sf):
    return asc.lag_correlations(day_table(spark, sf, "site"), "count", INTENT, CCF_LAGS, series="site")


@query("best_lag_by_site", f"""WITH {sql_days(True)}, {sql_lag_rows('days', 'count', INTENT, CCF_LAGS, 'site')}
SELECT site, lag AS best_lag, r AS best_r, n AS best_n, CASE WHEN abs(r) > 0.4 THEN 'strong' WHEN abs(r) > 0.2 THEN 'moderate' ELSE 'weak' END AS strength
FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY abs(r) DESC, lag) AS k FROM ccf) WHERE k = 1""", r6("best_r"))
def _(spark, sf):
    ccf = asc.lag_correlations(day_table(spark, sf, "site"), "count", INTENT, CCF_LAGS, series="site")
    return asc.best_lag(ccf, series="site")


CROSS = f"""{sql_days()}, {ANSWERS},
a AS (SELECT date, count(*) AS n_0 FROM answers WHERE contains(prefecture, 'ASIA') GROUP BY date),
b AS (SELECT date, count(*) AS n_1 FROM answers WHERE contains(prefecture, 'EUROPE') GROUP BY date),
merged AS (SELECT date, count, n_0, n_1 FROM counts LEFT JOIN a USING (date) LEFT JOIN b USING (date) WHERE n_0 IS NOT NULL AND n_1 IS NOT NULL)"""


def _cross_rows(column: str, region: str) -> str:
    shifted = ", ".join(f"{sql_shift(column, k, 'ORDER BY date')} AS x{i}" for i, k in enumerate(CCF_LAGS))
    rows = "\nUNION ALL ".join(
        f"SELECT '{region}' AS region, CAST({k} AS INT) AS lag, corr(count, x{i}) AS r, count(x{i}) AS n FROM s_{column}" for i, k in enumerate(CCF_LAGS))
    return f"s_{column} AS (SELECT date, count, {shifted} FROM merged), c_{column} AS ({rows})"


@query("cross_region_ccf", f"""WITH {CROSS}, {_cross_rows('n_0', 'ASIA')}, {_cross_rows('n_1', 'EUROPE')}
SELECT region, lag, r, n, abs(r) > 0.3 AS is_peak FROM (SELECT * FROM c_n_0 UNION ALL SELECT * FROM c_n_1) WHERE n > 10""", r6("r"))
def _(spark, sf):
    return st.cross_region_ccf(count_days(spark, sf), answers(spark, sf), ["ASIA", "EUROPE"])


@query("site_region_ccf", f"""WITH {sql_days(True)}, {ANSWERS}, a AS (SELECT date, count(*) AS answers_n FROM answers WHERE contains(prefecture, 'ASIA') GROUP BY date),
merged AS (SELECT site, date, count, answers_n FROM counts JOIN a USING (date)), {sql_lag_rows('merged', 'count', 'answers_n', CCF_LAGS, 'site')}
SELECT site, lag AS best_lag, r AS best_r, n AS best_n, CASE WHEN abs(r) > 0.4 THEN 'strong' WHEN abs(r) > 0.2 THEN 'moderate' ELSE 'weak' END AS strength
FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY abs(r) DESC, lag) AS k FROM ccf WHERE n > 20) WHERE k = 1""", r6("best_r"))
def _(spark, sf):
    return st.site_ccf(count_days(spark, sf, "site"), answers(spark, sf), "ASIA")


@query("spearman_by_site", f"""WITH {sql_days(True)}, ranked AS (SELECT site,
  {sql_rank(INTENT, 'site')} AS rx, {sql_rank('count', 'site')} AS ry
  FROM days WHERE {INTENT} IS NOT NULL),
s AS (SELECT site, corr(rx, ry) AS rho, count(*) AS n FROM ranked GROUP BY site)
SELECT site, '{INTENT}' AS x, 'count' AS y, rho, n, {sql_corr_p('rho', 'n')} AS p FROM s""", r6("rho", "p"))
def _(spark, sf):
    return asc.spearman(day_table(spark, sf, "site"), [(INTENT, "count")], series="site")


@query("pearson_test_by_site", f"""WITH {sql_days(True)}, s AS (SELECT site, corr(count, temp) AS r, count(*) AS n FROM days GROUP BY site)
SELECT site, r, n, {sql_corr_p('r', 'n')} AS p FROM s""", r6("r", "p"))
def _(spark, sf):
    return asc.pearson_test(day_table(spark, sf, "site"), "count", "temp", series="site")


def sql_chi2_p(x: str) -> str:
    """Tail of chi-square with one degree of freedom as the t tail at very many degrees would be too coarse: Simpson's
    rule on the normal density from sqrt(x) to sqrt(x) + 12."""
    weight = "CASE WHEN i = 0 OR i = 6000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(SELECT 2 * sum({weight} * exp(-pow(sqrt({x}) + i * 0.002, 2) / 2)) * 0.002 / 3 / sqrt(2 * pi()) FROM range(6001) AS s(i))"


@query("two_by_two_test", f"""WITH {TEXTS}, t AS (SELECT prefecture, CAST(count(*) FILTER (WHERE satisfaction IN (1, 2) AND {sql_any('reason', WORDS)}) AS DOUBLE) AS hits_a,
  CAST(count(*) FILTER (WHERE satisfaction IN (1, 2)) AS DOUBLE) AS n_a, CAST(count(*) FILTER (WHERE satisfaction IN (4, 5) AND {sql_any('reason', WORDS)}) AS DOUBLE) AS hits_b,
  CAST(count(*) FILTER (WHERE satisfaction IN (4, 5)) AS DOUBLE) AS n_b FROM texts GROUP BY prefecture),
c AS (SELECT *, (n_a + n_b) * pow(greatest(abs(hits_a * (n_b - hits_b) - (n_a - hits_a) * hits_b) - (n_a + n_b) / 2, 0), 2)
  / nullif(n_a * n_b * (hits_a + hits_b) * (n_a + n_b - hits_a - hits_b), 0) AS chi2 FROM t)
SELECT prefecture, CAST(hits_a AS BIGINT) AS hits_a, CAST(n_a AS BIGINT) AS n_a, CAST(hits_b AS BIGINT) AS hits_b, CAST(n_b AS BIGINT) AS n_b,
  chi2, CASE WHEN chi2 IS NOT NULL THEN {sql_chi2_p('chi2')} END AS p FROM c""", r6("chi2", "p"))
def _(spark, sf):
    table = asc.two_by_two(texts(spark, sf), contains_any("reason", WORDS), F.coalesce(F.col("satisfaction").isin(1, 2), F.lit(False)),
                           F.coalesce(F.col("satisfaction").isin(4, 5), F.lit(False)), series="prefecture")
    return asc.proportion_test(table)


@query("iqr_outlier_flags", f"""WITH {sql_days(True)}, f AS (SELECT site, quantile_cont(count, 0.25) AS q1, quantile_cont(count, 0.75) AS q3 FROM days GROUP BY site)
SELECT site, date, count, count < q1 - 1.5 * (q3 - q1) OR count > q3 + 1.5 * (q3 - q1) AS is_outlier FROM days JOIN f USING (site)""")
def _(spark, sf):
    return dl.flag_outliers(count_days(spark, sf, "site"), "count", series="site")


@query("zscore_outliers", f"""WITH {READINGS}, m AS (SELECT site, avg(people) AS mu, stddev_samp(people) AS sd FROM readings GROUP BY site)
SELECT site, count(*) FILTER (WHERE abs(people - mu) / sd > 1.6) AS n_outliers FROM readings JOIN m USING (site) GROUP BY site""")
def _(spark, sf):
    profile = ql.column_profile(readings(spark, sf), ["people"], series="site", z=1.6)
    return profile.select("site", F.col("n_outliers_zscore").alias("n_outliers"))


# Every step of the drift test from a table ``long`` (site, name, date, value) on.
DRIFT_STEPS = """present AS (SELECT DISTINCT site, name, date_trunc('month', date) AS m FROM long),
blocks AS (SELECT site, name, m, CAST(floor((row_number() OVER (PARTITION BY site, name ORDER BY m) - 1) / 3) AS INT) AS b FROM present),
placed AS (SELECT site, name, b, value FROM long JOIN blocks USING (site, name) WHERE m = date_trunc('month', date)),
moments AS (SELECT site, name, b, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM placed GROUP BY 1, 2, 3),
spans AS (SELECT site, name, b, strftime(min(m), '%Y-%m') || '/' || strftime(max(m), '%Y-%m') AS period FROM blocks GROUP BY 1, 2, 3),
sides AS (SELECT site, name, b AS pair, value, 1 AS a, 0 AS z FROM placed UNION ALL SELECT site, name, b - 1, value, 0, 1 FROM placed),
steps AS (SELECT site, name, pair, value, sum(a) AS a, sum(z) AS z FROM sides GROUP BY 1, 2, 3, 4),
cdf AS (SELECT site, name, pair, sum(a) OVER w / nullif(sum(a) OVER g, 0) AS fa, sum(z) OVER w / nullif(sum(z) OVER g, 0) AS fz FROM steps
  WINDOW w AS (PARTITION BY site, name, pair ORDER BY value), g AS (PARTITION BY site, name, pair)),
ks AS (SELECT site, name, pair, max(abs(fa - fz)) AS d FROM cdf GROUP BY 1, 2, 3)"""
DRIFT = f"""long AS (SELECT site, date, 'people' AS name, CAST(people AS DOUBLE) AS value FROM readings UNION ALL SELECT site, date, 'temp_c', temp_c FROM readings),
{DRIFT_STEPS}"""


@query("drift_between_blocks", f"""WITH {READINGS}, {DRIFT}
SELECT site, name, x.period AS period_a, y.period AS period_b, a.n AS rows_a, z.n AS rows_b, a.mean AS mean_a, z.mean AS mean_b, a.std AS std_a, z.std AS std_b,
  round_even(d, 4) AS ks_statistic
FROM ks JOIN moments a USING (site, name) JOIN moments z USING (site, name) JOIN spans x USING (site, name) JOIN spans y USING (site, name)
WHERE a.b = pair AND z.b = pair + 1 AND x.b = pair AND y.b = pair + 1 AND a.n >= 10 AND z.n >= 10""", r6("mean_a", "mean_b", "std_a", "std_b"))
def _(spark, sf):
    return ql.drift(readings(spark, sf), ["people", "temp_c"], series="site").drop("ks_pvalue", "drift_detected", "ks_law")


@query("drift_pvalues")
def _(spark, sf):
    return ql.drift(readings(spark, sf), ["people", "temp_c"], series="site").select(
        "site", "name", "period_a", "period_b", "ks_statistic", "ks_pvalue", "drift_detected", "ks_law")


def sql_series_ks(d: str, n: str) -> str:
    """P of the one-sample law by Pelz and Good's series, terms -30 to 30."""
    z, root = f"(sqrt({n}) * {d})", "sqrt(pi() / 2)"

    def total(term: str, half: bool) -> str:
        u = f"pow(pi() * (k{' + 0.5' if half else ''}), 2)"
        return f"list_sum(list_transform(range(-30, 31), lambda k: ({term.replace('U', u)}) * exp(-{u} / (2 * Z * Z))))"

    terms = (f"{root} / Z * {total('1', True)}"
             f" + {root} / (6 * pow(Z, 4)) * {total('U - Z * Z', True)} / sqrt({n})"
             f" + ({root} / (72 * pow(Z, 7)) * {total('6 * pow(Z, 6) + 2 * pow(Z, 4) + (2 * pow(Z, 4) - 5 * Z * Z) * U + (1 - 2 * Z * Z) * U * U', True)}"
             f" - {root} / (36 * pow(Z, 3)) * {total('U', False)}) / {n}"
             f" + ({root} / (6480 * pow(Z, 10)) * {total('(5 - 30 * Z * Z) * U * U * U + (212 * pow(Z, 4) - 60 * Z * Z) * U * U + (135 * pow(Z, 4) - 96 * pow(Z, 6)) * U - (30 * pow(Z, 6) + 90 * pow(Z, 8))', True)}"
             f" + {root} / (108 * pow(Z, 6)) * {total('3 * Z * Z * U - U * U', False)}) / pow({n}, 1.5)")
    return f"CASE WHEN {z} <= 0 THEN 1 WHEN {z} > 6 THEN 0 ELSE least(1, greatest(0, 1 - ({terms.replace('Z', z)}))) END"


DRIFT_TESTS = f"""tests AS (SELECT site, name, x.period AS period_a, y.period AS period_b, d, a.n * z.n / (a.n + z.n)::DOUBLE AS rows
FROM ks JOIN moments a USING (site, name) JOIN moments z USING (site, name) JOIN spans x USING (site, name) JOIN spans y USING (site, name)
WHERE a.b = pair AND z.b = pair + 1 AND x.b = pair AND y.b = pair + 1 AND a.n >= 10 AND z.n >= 10),
p AS (SELECT *, {sql_series_ks('d', 'rows')} AS p FROM tests)"""


@query("drift_series_pvalues", f"""WITH {READINGS}, {DRIFT}, {DRIFT_TESTS}
SELECT site, name, period_a, period_b, round_even(p, 4) AS ks_pvalue, p < 0.05 AS drift_detected, 'series' AS ks_law FROM p""")
def _(spark, sf):
    return ql.drift(readings(spark, sf), ["people", "temp_c"], series="site", law="series").select(
        "site", "name", "period_a", "period_b", "ks_pvalue", "drift_detected", "ks_law")


@query("stationarity_tests")
def _(spark, sf):
    return rb.adf_test(day_table(spark, sf, "site"), ["count", INTENT], series="site")


@query("station_rain_and_heat", f"""WITH {HOURS}, days AS (SELECT station, CAST(timestamp AS DATE) AS date, sum(precip_1h_mm) AS precip, avg(temp_c) AS temp FROM hours GROUP BY 1, 2)
SELECT station, corr(precip, temp) AS r, count(*) AS n FROM days GROUP BY station""", r6("r"))
def _(spark, sf):
    days = dl.daily_measures(hours(spark, sf).withColumn("date", F.to_date("timestamp")), series="station", sums={"precip_1h_mm": "precip"}, means={"temp_c": "temp"})
    return asc.pearson_test(days, "precip", "temp", series="station").drop("p")


@query("calendar_gaps_per_source", """WITH seen AS (SELECT DISTINCT l_suppkey AS site, CAST(l_shipdate AS DATE) AS date FROM lineitem),
span AS (SELECT site, min(date) AS lo, max(date) AS hi FROM seen GROUP BY site)
SELECT site, CAST(date_diff('day', lo, hi) + 1 - (SELECT count(*) FROM seen WHERE seen.site = span.site) AS BIGINT) AS n_gaps FROM span WHERE n_gaps > 0""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("site"), F.to_date("l_shipdate").alias("date"))
    return ql.date_gaps(rows, series="site").groupBy("site").agg(F.count("*").alias("n_gaps"))
