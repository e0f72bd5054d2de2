"""Comfort, demand gap, text and multi-site queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygauge.functions import scalars as sc
from daygauge.operators import comfort as cf
from daygauge.operators import daily as dl
from daygauge.operators import features as ft
from daygauge.operators import gap as gp
from daygauge.operators import regression as rg
from daygauge.operators import sites as st
from daygauge.operators import text as tx
from daygauge.plans.models import SITE_FIT
from daygauge.plans.registry import query, r6
from daygauge.plans.roles import (ALL_TEXT, ANSWERS, CROWD_WORDS, FEATURES, FEW, INTENT, QUIET_WORDS, RANKS, SITES, SPEND, TEXTS,
                                  USD_RATE, WORDS, answers, count_days, day_table, feature_table, intent_days, landed_days, readings, sql_any, sql_corr_p, sql_days, sql_rank,
                                  sql_features, sql_ols, sql_predicted, texts, weather_days)
from daygauge.plans.statistics import sql_chi2_p
from daygauge.plans.tables import SITE_MODEL, WIDE, site_model, three_sites
from daygauge.session import durable
from daygauge.sources.survey import answers as survey_shape

# ---------------------------------------------------------------- features


@query("weather_severity", f"WITH {sql_features()} SELECT date, weather_severity FROM features")
def _(spark, sf):
    return feature_table(spark, sf).select("date", "weather_severity")


@query("interaction_features", f"WITH {sql_features(True)} SELECT site, date, weekend_x_severity, weekend_x_intent FROM features")
def _(spark, sf):
    return feature_table(spark, sf, "site").select("site", "date", "weekend_x_severity", "weekend_x_intent")


FEATURE_DOUBLES = {c: 9 for c in ("precip", "temp", "sun", "wind", "precip_lag1", f"{INTENT}_roll7", "dow_mean_count")}


@query("full_feature_table", f"WITH {sql_features(True)} SELECT site, date, count, {', '.join(FEATURES)} FROM features", FEATURE_DOUBLES)
def _(spark, sf):
    rows = feature_table(spark, sf, "site")
    return rows.select("site", "date", "count", *ft.feature_names(rows, INTENT))


# ---------------------------------------------------------------- comfort

SQL_DI = "0.81::DOUBLE * temp + 0.01::DOUBLE * {h} * (0.99::DOUBLE * temp - 14.3) + 46.3"
SQL_WC = """CASE WHEN temp <= 10 AND wind * 3.6::DOUBLE > 4.8 THEN 13.12 + 0.6215::DOUBLE * temp - 11.37::DOUBLE * pow(greatest(wind * 3.6::DOUBLE, 0.1), 0.16)
  + 0.3965::DOUBLE * temp * pow(greatest(wind * 3.6::DOUBLE, 0.1), 0.16) ELSE temp END"""


@query("discomfort_index", f"""WITH {sql_days()} SELECT date, {SQL_DI.format(h='humidity')} AS di, 0.75::DOUBLE * temp + 0.0125::DOUBLE * temp * humidity - 0.25::DOUBLE * humidity + 50 AS di_custom FROM weather""")
def _(spark, sf):
    custom = sc.discomfort_index("temp", "humidity", (0.75, 0.0125, -0.25, 50.0))
    return weather_days(spark, sf).select("date", sc.discomfort_index("temp", "humidity").alias("di"), custom.alias("di_custom"))


@query("wind_chill", f"WITH {sql_days(True)} SELECT site, date, {SQL_WC} AS chill FROM weather", r6("chill"))
def _(spark, sf):
    return weather_days(spark, sf, "site").select("site", "date", sc.wind_chill("temp", "wind").alias("chill"))


COMFORT = f"""comfort AS (SELECT site, date, CASE WHEN count(humidity) OVER (PARTITION BY site) > 30 THEN {SQL_DI.format(h='humidity')}
  ELSE {SQL_DI.format(h='60')} END AS discomfort_index, {SQL_WC} AS wind_chill FROM weather)"""


def comfort(spark, sf) -> DataFrame:
    return cf.comfort_days(weather_days(spark, sf, "site"), series="site")


@query("comfort_means", f"WITH {sql_days(True)}, {COMFORT} SELECT site, avg(discomfort_index) AS di_mean, avg(wind_chill) AS wc_mean FROM comfort GROUP BY site", r6("di_mean", "wc_mean"))
def _(spark, sf):
    return cf.comfort_means(comfort(spark, sf), series="site")


@query("comfort_without_humidity", f"WITH {sql_days()} SELECT avg({SQL_DI.format(h='60')}) AS di_mean FROM weather", r6("di_mean"))
def _(spark, sf):
    return cf.comfort_means(cf.comfort_days(weather_days(spark, sf).select("date", "temp")))


SAT = "sat AS (SELECT date, avg(satisfaction) AS mean_satisfaction, count(satisfaction) AS n_responses, avg(nps_raw) AS mean_nps FROM answers GROUP BY date)"


def sql_spearman(source: str, pairs, by: str = "site") -> str:
    key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    rows = []
    for x, y in pairs:
        rows.append(f"SELECT {key}'{x}' AS x, '{y}' AS y, corr(rx, ry) AS rho, count(*) AS n FROM (SELECT {key}{sql_rank(x, by)} AS rx, {sql_rank(y, by)} AS ry "
                    f"FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL){group}")
    return f"spear AS ({' UNION ALL '.join(rows)})"


COMFORT_PAIRS = [("discomfort_index", "mean_satisfaction"), ("wind_chill", "mean_satisfaction"), ("discomfort_index", "mean_nps")]
MERGED = "merged AS (SELECT * FROM comfort JOIN sat USING (date))"


@query("comfort_vs_satisfaction", f"""WITH {sql_days(True)}, {ANSWERS}, {SAT}, {COMFORT}, {MERGED}, {sql_spearman('merged', COMFORT_PAIRS)}
SELECT site, x, y, rho, n, {sql_corr_p('rho', 'n')} AS p FROM spear""", r6("rho", "p"))
def _(spark, sf):
    return cf.comfort_correlations(comfort(spark, sf), cf.satisfaction_daily(answers(spark, sf)), series="site")


@query("satisfaction_peak_bin", f"""WITH {sql_days(True)}, {ANSWERS}, {SAT}, {COMFORT}, {MERGED},
e AS (SELECT site, list_sort(list_distinct(quantile_cont(discomfort_index, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS u FROM merged GROUP BY site),
b AS (SELECT site, mean_satisfaction, u, len(list_filter(u[2:len(u) - 1], lambda x: x < discomfort_index)) + 1 AS k FROM merged JOIN e USING (site)),
m AS (SELECT site, u[k] AS lo, u[k + 1] AS hi, avg(mean_satisfaction) AS peak_mean, count(*) AS peak_n FROM b GROUP BY 1, 2, 3)
SELECT site, lo AS peak_left, hi AS peak_right, (lo + hi) / 2 AS peak_mid, peak_mean, peak_n FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY peak_mean DESC, lo) AS r FROM m) WHERE r = 1""",
       r6("peak_left", "peak_right", "peak_mid", "peak_mean"))
def _(spark, sf):
    merged = comfort(spark, sf).join(cf.satisfaction_daily(answers(spark, sf)), "date")
    return cf.best_bin(merged, "discomfort_index", "mean_satisfaction", series="site")


# ---------------------------------------------------------------- crowding and satisfaction

EDGES, LABELS = (0, 300, 450, 600, 750, 900, 5000), ("<300", "300-450", "450-600", "600-750", "750-900", ">900")
MATCHED = f"""{sql_days()}, {ANSWERS}, sat AS (SELECT date, avg(satisfaction) AS mean_satisfaction, avg(nps_raw) AS mean_nps FROM answers WHERE contains(prefecture, 'ASIA') GROUP BY date),
matched AS (SELECT date, CAST(count AS DOUBLE) AS count, mean_satisfaction, mean_nps, coalesce(mean_nps, mean_satisfaction) AS nps_or_satisfaction FROM days JOIN sat USING (date))"""


def matched(spark, sf) -> DataFrame:
    return cf.match_satisfaction(count_days(spark, sf), cf.satisfaction_daily(answers(spark, sf), region="ASIA"))


SQL_BINS = " ".join(f"WHEN count > {lo} AND count <= {hi} THEN '{name}'" for lo, hi, name in zip(EDGES, EDGES[1:], LABELS))


@query("crowding_bins", f"""WITH {MATCHED} SELECT CASE {SQL_BINS} END AS visitor_bin, avg(mean_satisfaction) AS mean_satisfaction, avg(mean_nps) AS mean_nps, count(*) AS n
FROM matched WHERE count > 0 AND count <= 5000 GROUP BY 1""", r6("mean_satisfaction", "mean_nps"))
def _(spark, sf):
    return cf.crowding_bins(matched(spark, sf), edges=EDGES, labels=LABELS)


CROWD_PAIRS = [("count", "mean_satisfaction"), ("count", "nps_or_satisfaction")]


@query("crowding_correlations", f"WITH {MATCHED}, {sql_spearman('matched', CROWD_PAIRS, '')} SELECT x, y, rho, n, {sql_corr_p('rho', 'n')} AS p FROM spear", r6("rho", "p"))
def _(spark, sf):
    return cf.crowding_correlations(matched(spark, sf))


# ---------------------------------------------------------------- demand gap

FLAGGED = f"""flagged AS (SELECT d.*, CAST(coalesce({INTENT} > mi, false) AS INT) AS high_intent, CAST(count < mc AS INT) AS low_count,
  CAST(coalesce({INTENT} > mi, false) AND count < mc AS INT) AS opportunity_gap
  FROM days d JOIN (SELECT site, median({INTENT}) AS mi, median(count) AS mc FROM days GROUP BY site) m USING (site))"""


def flagged(spark, sf) -> DataFrame:
    return gp.opportunity_gap(day_table(spark, sf, "site"), INTENT, series="site")


@query("opportunity_gap_flags", f"WITH {sql_days(True)}, {FLAGGED} SELECT site, date, high_intent, low_count, opportunity_gap FROM flagged")
def _(spark, sf):
    return flagged(spark, sf).select("site", "date", "high_intent", "low_count", "opportunity_gap")


PROFILE = ["count", INTENT, "precip", "temp", "wind"]


@query("gap_profile", f"WITH {sql_days(True)}, {FLAGGED} " + "\nUNION ALL ".join(
    f"SELECT site, sum(opportunity_gap)::BIGINT AS gap_days, count(*) AS n_days, '{c}' AS measure, avg({c}) FILTER (WHERE opportunity_gap = 1) AS gap_mean, "
    f"avg({c}) FILTER (WHERE opportunity_gap = 0) AS other_mean, avg({c}) FILTER (WHERE opportunity_gap = 1) - avg({c}) FILTER (WHERE opportunity_gap = 0) AS difference FROM flagged GROUP BY site"
    for c in PROFILE), r6("gap_mean", "other_mean", "difference"))
def _(spark, sf):
    return gp.gap_profile(flagged(spark, sf), PROFILE, series="site")


LOST = f"""{SITE_FIT}, {FLAGGED}, lost AS (SELECT few.site, few.date, few.count, {sql_predicted(FEW).replace('* ', '* few.')} - few.count AS lost_population
  FROM few JOIN fit USING (site) JOIN flagged ON flagged.site = few.site AND flagged.date = few.date WHERE opportunity_gap = 1)"""


def gap_days(spark, sf) -> DataFrame:
    days = landed_days(spark, sf, "site")
    rows = days.dropna(subset=["count", *FEW])
    predicted = rg.predict(rows, rg.ols(rows, "count", FEW, series="site"), FEW, series="site")
    return gp.lost_on_gap_days(predicted, gp.opportunity_gap(days, INTENT, series="site"), series="site")


@query("lost_population_days", f"WITH {LOST} SELECT * FROM lost", r6("lost_population"))
def _(spark, sf):
    return gap_days(spark, sf).select("site", "date", "count", "lost_population")


@query("lost_population", f"WITH {LOST} SELECT site, count(*) AS gap_days, sum(lost_population) AS total_lost, avg(lost_population) AS mean_lost FROM lost GROUP BY site",
       {"total_lost": 4, "mean_lost": 5})
def _(spark, sf):
    return gp.lost_summary(gap_days(spark, sf), series="site")


@query("economic_value", f"""WITH {LOST}, s AS (SELECT site, sum(lost_population) AS total_lost FROM lost GROUP BY site)
SELECT site, total_lost, total_lost * {SPEND} AS value, total_lost * {SPEND} / 1e9 AS value_billion, total_lost * {SPEND} / {USD_RATE} / 1e6 AS value_usd_million FROM s""",
       {"total_lost": 4, "value": 1, "value_billion": 6, "value_usd_million": 6})
def _(spark, sf):
    lost = gp.lost_summary(gap_days(spark, sf), series="site").select("site", "total_lost")
    return gp.economic_value(lost, "total_lost", SPEND, USD_RATE)


BASE = "base(month, rank, gap_k) AS (VALUES " + ", ".join(f"(CAST({m} AS INT), CAST({r} AS INT), {g}::DOUBLE)" for m, (r, g) in RANKS.items()) + ")"
# Weights of the months in the seasonal distribution; only their proportions count.
WEIGHTS = {m: 1.5 + 0.25 * abs(m - 7) for m in range(1, 13)}


def baseline(spark) -> DataFrame:
    return spark.createDataFrame([(m, r, g) for m, (r, g) in RANKS.items()], "month int, rank int, gap_k double")


def sql_simulation(floor: int) -> str:
    lost_k = "coalesce(monthly_lost, 0) / 1000"
    closure = f"CASE WHEN gap_k > 0 AND {lost_k} > 0 THEN {lost_k} / nullif(gap_k, 0) ELSE 0 END"
    gained = f"least(12, CAST(trunc(({closure}) * 12) AS INT))"
    return f"""sim AS (SELECT site, month, rank, gap_k, coalesce(monthly_lost, 0) AS monthly_lost, ({closure}) * 100 AS closure_pct, {gained} AS ranks_gained,
  greatest({floor}, rank - {gained}) AS new_rank FROM (SELECT DISTINCT site FROM monthly) CROSS JOIN base LEFT JOIN monthly USING (site, month))"""


BY_DAYS = f"{LOST}, {BASE}, monthly AS (SELECT site, CAST(month(date) AS INT) AS month, sum(lost_population) AS monthly_lost FROM lost GROUP BY 1, 2)"
WEIGHT_ROWS = "w(month, weight) AS (VALUES " + ", ".join(f"(CAST({m} AS INT), {v}::DOUBLE)" for m, v in WEIGHTS.items()) + ")"
SIM_DIGITS = {"monthly_lost": 4, "closure_pct": 5}


def weighted(weights: bool) -> str:
    share = f"weight / {sum(WEIGHTS.values())!r}" if weights else "1.0::DOUBLE / 12"
    return (f"{LOST}, {BASE}, {WEIGHT_ROWS}, total AS (SELECT site, 40.0::DOUBLE * sum(greatest(lost_population, 0)) AS t FROM lost GROUP BY site), "
            f"monthly AS (SELECT site, month, t * {share} AS monthly_lost FROM total CROSS JOIN w)")


def total_loss(spark, sf) -> DataFrame:
    # Forty sites' worth, so that the derived numbers move ranks.
    return durable(gap_days(spark, sf).groupBy("site").agg((40.0 * F.sum(F.greatest("lost_population", F.lit(0.0)))).alias("t")))


@query("rank_simulation_by_gap_days", f"WITH {BY_DAYS}, {sql_simulation(1)} SELECT * FROM sim", SIM_DIGITS)
def _(spark, sf):
    return gp.rank_simulation(baseline(spark), durable(gp.monthly_loss(gap_days(spark, sf), series="site")), series="site")


@query("rank_simulation_by_season", f"WITH {weighted(True)}, {sql_simulation(1)} SELECT * FROM sim", SIM_DIGITS)
def _(spark, sf):
    base = baseline(spark)
    return gp.rank_simulation(base, gp.spread_by_weight(base, total_loss(spark, sf), "t", WEIGHTS, series="site"), series="site")


@query("rank_simulation_even", f"WITH {weighted(False)}, {sql_simulation(1)} SELECT * FROM sim", SIM_DIGITS)
def _(spark, sf):
    base = baseline(spark)
    return gp.rank_simulation(base, gp.spread_by_weight(base, total_loss(spark, sf), "t", series="site"), series="site")


@query("rank_projection_with_floor", f"WITH {weighted(True)}, {sql_simulation(35)} SELECT * FROM sim", SIM_DIGITS)
def _(spark, sf):
    base = baseline(spark)
    return gp.rank_simulation(base, gp.spread_by_weight(base, total_loss(spark, sf), "t", WEIGHTS, series="site"), series="site", floor=35)


@query("rank_summary", f"""WITH {weighted(True)}, {sql_simulation(1)} SELECT site, avg(rank) FILTER (WHERE month IN (12, 1, 2)) AS winter_rank,
avg(new_rank) FILTER (WHERE month IN (12, 1, 2)) AS winter_new_rank, max(ranks_gained) AS best_gain, min(closure_pct) FILTER (WHERE gap_k > 0) AS min_closure_pct,
max(closure_pct) FILTER (WHERE gap_k > 0) AS max_closure_pct FROM sim GROUP BY site""", {"winter_rank": 6, "winter_new_rank": 6, "min_closure_pct": 5, "max_closure_pct": 5})
def _(spark, sf):
    base = baseline(spark)
    sim = gp.rank_simulation(base, gp.spread_by_weight(base, total_loss(spark, sf), "t", WEIGHTS, series="site"), series="site")
    return gp.rank_summary(sim, series="site")


# ---------------------------------------------------------------- text

HIT = f"({sql_any(ALL_TEXT, WORDS)} AND length(trim({ALL_TEXT}, ' ')) >= 3)"


@query("complaint_rates", f"""WITH {TEXTS}, c AS (SELECT prefecture, count(*) AS n_texts, count(*) FILTER (WHERE satisfaction IN (1, 2)) AS n_low, count(*) FILTER (WHERE satisfaction IN (1, 2) AND {HIT}) AS low_hits,
  count(*) FILTER (WHERE satisfaction IN (4, 5)) AS n_high, count(*) FILTER (WHERE satisfaction IN (4, 5) AND {HIT}) AS high_hits FROM texts GROUP BY prefecture),
p AS (SELECT *, CASE WHEN n_low > 0 THEN low_hits * 100.0::DOUBLE / n_low ELSE 0 END AS low_pct, CASE WHEN n_high > 0 THEN high_hits * 100.0::DOUBLE / n_high ELSE 0.01 END AS high_pct,
  (n_low + n_high) * pow(greatest(abs(low_hits::DOUBLE * (n_high - high_hits) - (n_low - low_hits) * high_hits) - (n_low + n_high) / 2.0, 0), 2)
  / nullif(n_low::DOUBLE * n_high * (low_hits + high_hits) * (n_low + n_high - low_hits - high_hits), 0) AS chi2 FROM c)
SELECT *, low_pct / greatest(high_pct, 0.1) AS ratio, CASE WHEN chi2 IS NOT NULL THEN {sql_chi2_p('chi2')} END AS p FROM p""", r6("low_pct", "high_pct", "ratio", "chi2", "p"))
def _(spark, sf):
    return tx.complaint_rates(texts(spark, sf), WORDS, series="prefecture")


@query("complaint_examples", f"""WITH {TEXTS} SELECT doc_id, satisfaction, CASE {' '.join(f"WHEN contains({ALL_TEXT}, '{w}') THEN '{w}'" for w in WORDS)} END AS keyword,
substr({ALL_TEXT}, 1, 120) AS excerpt FROM texts WHERE satisfaction IN (1, 2) AND {HIT} ORDER BY doc_id LIMIT 5""")
def _(spark, sf):
    return tx.complaint_examples(texts(spark, sf), WORDS, ["doc_id"])


SITE_TEXT = "coalesce(reason, '')"
RESILIENCE = f"""rows AS (SELECT date, satisfaction AS s, {sql_any(SITE_TEXT, CROWD_WORDS)} AS crowd, {sql_any(SITE_TEXT, QUIET_WORDS)} AS quiet FROM texts WHERE contains(location, 'src1')),
c AS (SELECT count(*) AS n_responses, count(*) FILTER (WHERE s IN (4, 5)) AS n_high, count(*) FILTER (WHERE s IN (1, 2)) AS n_low, count(*) FILTER (WHERE crowd) AS n_crowd,
  count(*) FILTER (WHERE crowd AND s IN (1, 2)) AS n_crowd_low, count(*) FILTER (WHERE quiet AND s IN (1, 2)) AS n_quiet_low FROM rows),
d AS (SELECT date, count(s) AS n, avg(s) AS mean_sat FROM rows WHERE s IS NOT NULL GROUP BY date HAVING count(s) >= 3),
r AS (SELECT {sql_rank('n')} AS rx, {sql_rank('mean_sat')} AS ry FROM d),
l AS (SELECT count(*) AS n_days, corr(rx, ry) AS rho FROM r)"""


@query("site_resilience", f"""WITH {TEXTS}, {RESILIENCE} SELECT n_responses, n_low, n_days, CASE WHEN n_days >= 10 THEN round_even(rho, 3) END AS spearman_r,
CASE WHEN n_days >= 10 THEN round_even({sql_corr_p('rho', 'n_days')}, 4) END AS spearman_p, round_even(n_high * 100.0::DOUBLE / n_responses, 1) AS sat_rate_pct,
round_even(n_crowd * 100.0::DOUBLE / n_responses, 1) AS congestion_pct, round_even(n_crowd_low * 100.0::DOUBLE / nullif(n_low, 0), 1) AS congestion_low_sat_pct,
n_quiet_low AS undervibrancy_low_sat FROM c, l WHERE n_responses >= 20""")
def _(spark, sf):
    return tx.site_resilience(texts(spark, sf), "src1", crowd_words=CROWD_WORDS, quiet_words=QUIET_WORDS, texts=("reason",))


@query("rating_labels_to_numbers", f"WITH {ANSWERS} SELECT o_orderkey, CASE rating_label WHEN '1-URGENT' THEN 1.0::DOUBLE WHEN '2-HIGH' THEN 2 WHEN '5-LOW' THEN 5 END AS rating FROM answers")
def _(spark, sf):
    labels = {"1-URGENT": 1, "2-HIGH": 2, "5-LOW": 5}
    return answers(spark, sf).select("o_orderkey", tx.rating_number("rating_label", labels).alias("rating"))


@query("survey_shape", f"""WITH {TEXTS} SELECT prefecture, date, satisfaction, CAST(NULL AS DOUBLE) AS satisfaction_service, TRY_CAST(regexp_extract(location, '(\\d+)', 1) AS DOUBLE) AS nps_raw,
coalesce(location, '') AS location, coalesce(reason, '') AS reason, coalesce(inconvenience, '') AS inconvenience, '' AS freetext FROM texts""")
def _(spark, sf):
    rows = texts(spark, sf).withColumn("nps", F.col("location")).drop("freetext")
    return survey_shape(rows)


# ---------------------------------------------------------------- sites

SITE_FEATURES = [INTENT, "temp", "precip", "wind", "snow_depth"]
NODES = f"""{sql_days(True)}, {SITE_MODEL}, {sql_ols('site_model', 'count', SITE_FEATURES, ['site'])}, {sql_ols('site_model', 'count', [INTENT], ['site'], name='line')},
sd AS (SELECT site, stddev_pop(snow_depth) AS sx, stddev_pop(count) AS sy FROM site_model GROUP BY site),
shortfall AS (SELECT site, sum(greatest(b0 + b1 * {INTENT} - count, 0)) AS lost_visitors FROM site_model JOIN (SELECT site, b0, b1 FROM line) USING (site) GROUP BY site),
metrics AS (SELECT site, fit.n, 1 - fit.sse / fit.sst AS r2, 1 - (fit.sse / fit.sst) * (fit.n - 1) / (fit.n - 6) AS adj_r2, line.sse / line.sst - fit.sse / fit.sst AS weather_lift,
  fit.b4 AS wind_coef, fit.b5 * sx / sy AS snow_beta_std, lost_visitors, lost_visitors * {SPEND} AS lost_value
  FROM fit JOIN line USING (site) JOIN sd USING (site) JOIN shortfall USING (site))"""
NODE_DIGITS = {**r6("r2", "adj_r2", "weather_lift", "wind_coef", "snow_beta_std"), "lost_visitors": 4, "lost_value": 1}


def metrics(spark, sf) -> DataFrame:
    return st.site_metrics(site_model(spark, sf), INTENT, spend=SPEND)


@query("site_metrics", f"WITH {NODES} SELECT * FROM metrics", NODE_DIGITS)
def _(spark, sf):
    return metrics(spark, sf)


@query("site_snow_ranking", f"WITH {NODES} SELECT site, abs(snow_beta_std) AS snow_sensitivity FROM metrics ORDER BY 2 DESC, 1", r6("snow_sensitivity"))
def _(spark, sf):
    return st.rank_sites(metrics(spark, sf))


@query("most_and_least_sensitive", f"WITH {NODES} SELECT arg_max(site, abs(snow_beta_std)) AS most_sensitive, arg_min(site, abs(snow_beta_std)) AS least_sensitive FROM metrics")
def _(spark, sf):
    return st.most_and_least(metrics(spark, sf))


@query("site_totals", f"WITH {NODES} SELECT count(*) AS n_sites, sum(lost_visitors) AS lost_visitors, sum(lost_visitors) * {SPEND} AS lost_value FROM metrics", {"lost_visitors": 3, "lost_value": 0})
def _(spark, sf):
    return st.site_totals(metrics(spark, sf), SPEND)


SENSITIVITY = """t AS (SELECT site, abs(snow_beta_std) AS snow_sensitivity_abs, abs(wind_coef) AS wind_sensitivity_abs, weather_lift AS weather_lift_r2, lost_visitors / 1000 AS lost_visitors_k FROM metrics)"""
SENSITIVITY_COLUMNS = ("snow_sensitivity_abs", "wind_sensitivity_abs", "weather_lift_r2", "lost_visitors_k")


@query("site_sensitivity", f"WITH {NODES}, {SENSITIVITY} SELECT * FROM t", r6(*SENSITIVITY_COLUMNS))
def _(spark, sf):
    return st.sensitivity_table(metrics(spark, sf))


@query("site_sensitivity_normalised", f"WITH {NODES}, {SENSITIVITY} SELECT site, " + ", ".join(f"{c} / max({c}) OVER () AS {c}" for c in SENSITIVITY_COLUMNS) + " FROM t", r6(*SENSITIVITY_COLUMNS))
def _(spark, sf):
    return st.sensitivity_table(metrics(spark, sf), normalise=True)


NUDGE = ", ".join(f"(avg(count_{i}) FILTER (WHERE wind > 5.5) / avg(count_{i}) FILTER (WHERE wind <= 5.5) - 1) * 100 AS delta_pct_{i}" for i in range(3))


@query("wind_nudge", f"WITH {sql_days(True)}, {WIDE} SELECT count(*) FILTER (WHERE wind > 5.5) AS n_high, count(*) FILTER (WHERE wind <= 5.5) AS n_normal, {NUDGE} FROM wide",
       r6("delta_pct_0", "delta_pct_1", "delta_pct_2"))
def _(spark, sf):
    return st.wind_nudge(three_sites(spark, sf), threshold=5.5)


@query("weather_shield", f"""WITH {sql_days(True)}, {WIDE}, m AS (SELECT median(count_0) AS med FROM wide)
SELECT count(*) FILTER (WHERE wind > 5.5 AND count_0 < med) AS n_shield, (avg(count_2) FILTER (WHERE wind > 5.5 AND count_0 < med) / avg(count_2) FILTER (WHERE wind <= 5.5) - 1) * 100 AS shield_pct FROM wide, m""",
       r6("shield_pct"))
def _(spark, sf):
    return st.weather_shield(three_sites(spark, sf), threshold=5.5)


PROXY = """proxy AS (SELECT date, count(*) AS count FROM answers WHERE coalesce(regexp_matches(town, 'NATION_1|NATION_2'), false) OR coalesce(regexp_matches(location, 'NATION_1|NATION_2'), false) GROUP BY date)"""


def proxy(spark, sf) -> DataFrame:
    return st.survey_proxy(answers(spark, sf), ["town", "location", "district"], "NATION_1|NATION_2")


@query("survey_proxy_days", f"WITH {ANSWERS}, {PROXY} SELECT * FROM proxy")
def _(spark, sf):
    return proxy(spark, sf)


@query("proxy_validation", f"""WITH {sql_days()}, {ANSWERS}, {PROXY}, s AS (SELECT corr(c.count, proxy.count) AS r, count(*) AS n FROM counts c JOIN proxy USING (date))
SELECT r, n, {sql_corr_p('r', 'n')} AS p FROM s WHERE n >= 30""", r6("r", "p"))
def _(spark, sf):
    return st.proxy_check(count_days(spark, sf), proxy(spark, sf))


@query("sites_with_proxy", f"""WITH {sql_days(True)}, {ANSWERS}, {PROXY} SELECT site, date, count, 'counter' AS source FROM counts UNION ALL SELECT 'P', date, count, 'survey_proxy' FROM proxy""")
def _(spark, sf):
    return st.with_proxy_sites(count_days(spark, sf, "site"), proxy(spark, sf), "P").select("site", "date", "count", "source")


RUN = f"""{sql_days(True)}, {ANSWERS}, {PROXY}, all_counts AS (SELECT site, date, count FROM counts UNION ALL SELECT 'P', date, count FROM proxy),
national AS (SELECT date, coalesce(sum(precip_1h_mm), 0) AS precip, avg(temp_c) AS temp, avg(wind_speed_ms) AS wind, avg(snow_depth_cm) AS snow_depth FROM readings GROUP BY date),
site_model AS (SELECT site, date, count, {INTENT}, temp, precip, wind, coalesce(snow_depth, 0) AS snow_depth FROM all_counts JOIN national USING (date) JOIN intent USING (date)),
{NODES.split('WITH ')[-1][NODES.index('fit_m AS'):]}"""


@query("multi_site_run", f"WITH {RUN} SELECT * FROM metrics", NODE_DIGITS)
def _(spark, sf):
    counts = st.with_proxy_sites(durable(count_days(spark, sf, "site")), proxy(spark, sf), "P").drop("source")
    national = dl.daily_measures(readings(spark, sf), sums={"precip_1h_mm": "precip"},
                                 means={"temp_c": "temp", "wind_speed_ms": "wind", "snow_depth_cm": "snow_depth"})
    model = durable(st.site_model_table(counts, national, intent_days(spark, sf), INTENT))
    return st.site_metrics(model, INTENT, spend=SPEND)


@query("days_common_to_sites", f"WITH {sql_days(True)} SELECT site, date, count FROM days WHERE date IN (SELECT date FROM days GROUP BY date HAVING count(*) = {len(SITES)})")
def _(spark, sf):
    return st.on_common_days(count_days(spark, sf, "site")).select("site", "date", "count")
