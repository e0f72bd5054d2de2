"""Data audit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygauge.operators import quality as ql
from daygauge.plans.registry import query, r6
from daygauge.plans.roles import ANSWERS, HOURS, READINGS, answers, count_days, hours, readings, sql_days, table
from daygauge.plans.statistics import DRIFT, DRIFT_STEPS, DRIFT_TESTS
from daygauge.session import durable, scratch_path
from daygauge.sources import sinks as sk

PROFILED = ["people", "temp_c", "wind_speed_ms", "snow_depth_cm"]
PROFILE_DIGITS = r6("mean", "std", "q25", "q75")


def sql_profile(source: str, columns: list[str], types: dict[str, str], by: str = "site") -> str:
    rows = []
    for c in columns:
        rows.append(f"""SELECT x.{by}, '{c}' AS name, '{types.get(c, 'double')}' AS dtype, any_value(n_total) AS n_total, any_value(n_missing) AS n_missing,
  round_even(any_value(n_missing) / greatest(any_value(n_total), 1) * 100, 2) AS pct_missing, any_value(mean) AS mean, any_value(std) AS std,
  any_value(lo) AS min, any_value(hi) AS max, any_value(q25) AS q25, any_value(q75) AS q75,
  count(*) FILTER (WHERE {c} < q25 - 1.5 * (q75 - q25) OR {c} > q75 + 1.5 * (q75 - q25)) AS n_outliers_iqr,
  count(*) FILTER (WHERE std > 0 AND abs({c} - mean) / std > 3.5) AS n_outliers_zscore
FROM {source} x JOIN (SELECT {by}, count(*) AS n_total, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, avg({c}) AS mean, stddev_samp({c}) AS std,
  CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.75) AS q75 FROM {source} GROUP BY {by}) p USING ({by}) GROUP BY 1""")
    return "\nUNION ALL ".join(rows)


@query("column_profile", f"WITH {READINGS} {sql_profile('readings', PROFILED, {'people': 'bigint'})}", PROFILE_DIGITS)
def _(spark, sf):
    return ql.column_profile(readings(spark, sf), PROFILED, series="site")


@query("price_profile", "WITH l AS (SELECT l_returnflag AS site, l_extendedprice, l_quantity FROM lineitem) " + sql_profile("l", ["l_extendedprice", "l_quantity"], {}),
       {"mean": 5, "std": 5, "q25": 6, "q75": 6})
def _(spark, sf):
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "site")
    return ql.column_profile(rows, ["l_extendedprice", "l_quantity"], series="site")


def counter_audit(spark, sf, law="auto") -> DataFrame:
    return ql.counter_report(durable(count_days(spark, sf)), ["aggregate from", "aggregate to", "total count"], law=law)


def weather_audit(spark, sf, law="auto") -> DataFrame:
    return ql.weather_report(durable(hours(spark, sf)), series="station", stations=(*STATIONS, "closed"), law=law)


def survey_audit(spark, sf) -> DataFrame:
    return ql.survey_report(durable(answers(spark, sf)), satisfaction="satisfaction", region="prefecture", expected=("satisf", "nps", "income"))


BLOCK_COUNT = """blocks AS (SELECT date_trunc('month', date) AS m, row_number() OVER (ORDER BY date_trunc('month', date)) - 1 AS k FROM (SELECT DISTINCT date_trunc('month', date) AS date FROM days))"""


@query("counter_report", f"""WITH {sql_days()}, {BLOCK_COUNT} SELECT 'counter' AS source_name, count(*) AS n_rows, CAST(3 AS INT) AS n_columns, min(date) AS first_date, max(date) AS last_date,
CAST(date_diff('day', min(date), max(date)) + 1 - count(*) AS BIGINT) AS n_gaps, CAST(0 AS INT) AS n_missing_columns, CAST(1 AS INT) AS n_checks,
(SELECT CAST(floor(max(k) / 3) AS INT) FROM blocks) AS n_drift_checks, CAST(CASE WHEN date_diff('day', min(date), max(date)) + 1 > count(*) THEN 1 ELSE 0 END AS INT) AS n_warnings,
count(*) > 0 AS passed FROM days""")
def _(spark, sf):
    return counter_audit(spark, sf).select(
        "source_name", "n_rows", "n_columns", "first_date", "last_date", "n_gaps", F.size("missing_columns").alias("n_missing_columns"),
        F.size("column_checks").alias("n_checks"), F.size("drift_checks").alias("n_drift_checks"), F.size("warnings").alias("n_warnings"), "passed")


def sql_weather_report(station: str) -> str:
    return f"""SELECT 'weather {station}' AS source_name, count(*) AS n_rows, CAST(7 AS INT) AS n_columns, min(CAST(timestamp AS DATE)) AS first_date, max(CAST(timestamp AS DATE)) AS last_date,
  CAST(date_diff('day', min(CAST(timestamp AS DATE)), max(CAST(timestamp AS DATE))) + 1 - count(DISTINCT CAST(timestamp AS DATE)) AS BIGINT) AS n_gaps, CAST(6 AS INT) AS n_checks,
  list_filter([CASE WHEN min(temp_c) < -40 THEN 'Suspicious minimum temperature.' END, CASE WHEN max(temp_c) > 50 THEN 'Suspicious maximum temperature.' END,
    CASE WHEN max(wind_speed_ms) > 60 THEN 'Extreme wind speed.' END], lambda x: x IS NOT NULL) AS w, min(precip_1h_mm) >= 0 AS passed FROM hours WHERE station = '{station}'"""


STATIONS = ("click", "error", "purchase", "signup", "view")
# A station without a row has a report too, and fails.
WEATHER_REPORTS = f"""r AS ({' UNION ALL '.join(sql_weather_report(s) for s in STATIONS)}
  UNION ALL SELECT 'weather closed', 0, 7, NULL, NULL, 0, 0, [], false)"""


@query("weather_report", f"WITH {HOURS}, {WEATHER_REPORTS} SELECT * EXCLUDE (w), array_to_string(w, ' ') AS warnings FROM r")
def _(spark, sf):
    return weather_audit(spark, sf).select(
        "source_name", "n_rows", "n_columns", "first_date", "last_date", "n_gaps", F.size("column_checks").alias("n_checks"),
        F.array_join("warnings", " ").alias("warnings"), "passed")


@query("survey_report", f"""WITH {ANSWERS} SELECT 'survey' AS source_name, count(*) AS n_rows, CAST(10 AS INT) AS n_columns, count(*) FILTER (WHERE satisfaction < 1 OR satisfaction > 5) AS n_out_of_range,
count(DISTINCT prefecture) AS n_regions, count(*) FILTER (WHERE prefecture IS NULL) AS region_missing, round_even(count(*) FILTER (WHERE prefecture IS NULL) / greatest(count(*), 1) * 100, 2) AS region_pct_missing,
'income' AS missing_columns, avg(satisfaction) AS mean, CAST(1 AS INT) AS n_warnings, true AS passed FROM answers""", r6("mean"))
def _(spark, sf):
    return survey_audit(spark, sf).select(
        "source_name", "n_rows", "n_columns", "n_out_of_range", "n_regions", "region_missing", "region_pct_missing",
        F.array_join("missing_columns", ", ").alias("missing_columns"), F.col("column_checks")[0]["mean"].alias("mean"),
        F.size("warnings").alias("n_warnings"), "passed")


@query("audit_totals", f"""WITH {sql_days()}, {HOURS}, {ANSWERS}, {WEATHER_REPORTS},
long AS (SELECT 'counter' AS site, date, 'count' AS name, CAST(count AS DOUBLE) AS value FROM days
  UNION ALL SELECT station, CAST(timestamp AS DATE), 'temp_c', temp_c FROM hours UNION ALL SELECT station, CAST(timestamp AS DATE), 'precip_1h_mm', precip_1h_mm FROM hours
  UNION ALL SELECT station, CAST(timestamp AS DATE), 'wind_speed_ms', wind_speed_ms FROM hours), {DRIFT_STEPS}, {DRIFT_TESTS}, lines AS (
  SELECT n_rows AS n, len(w) + CAST(n_gaps > 0 AS INT) AS warnings, CAST(NOT passed AS INT) AS errors FROM r
  UNION ALL SELECT count(*), CAST(date_diff('day', min(date), max(date)) + 1 > count(*) AS INT) + CAST(count(*) FILTER (WHERE count = 0) > 0 AS INT), CAST(count(*) = 0 AS INT) FROM days
  UNION ALL SELECT count(*), 1 + CAST(count(*) FILTER (WHERE satisfaction NOT BETWEEN 1 AND 5) > 0 AS INT), CAST(count(*) = 0 AS INT) FROM answers)
SELECT count(*) AS total_sources_audited, CAST(sum(n) AS BIGINT) AS total_rows_audited, CAST(sum(warnings) AS BIGINT) AS total_warnings,
CAST(sum(errors) AS BIGINT) AS total_errors, (SELECT count(*) FROM p WHERE p < 0.05) AS total_drift_events, sum(errors) = 0 AS overall_passed FROM lines""")
def _(spark, sf):
    return ql.audit_totals([counter_audit(spark, sf, "series"), weather_audit(spark, sf, "series"), survey_audit(spark, sf)])


@query("audit_report_json", f"""WITH {READINGS}, d AS (SELECT site, date, CAST(sum(people) AS BIGINT) AS count FROM readings GROUP BY 1, 2)
SELECT 'counter ' || site AS source_name, count(*) AS n_rows, CAST(avg(count) AS DOUBLE) AS mean, median(count) IS NOT NULL AS passed FROM d GROUP BY site""", r6("mean"))
def _(spark, sf):
    days = durable(count_days(spark, sf, "site"))
    path = scratch_path(spark, "audit")
    sk.write_report(ql.counter_report(days, ["aggregate from", "aggregate to", "total count"], series="site"), path)
    report = spark.read.json(path)
    return report.select("source_name", "n_rows", F.col("column_checks")[0]["mean"].alias("mean"), "passed")


@query("drift_blocks_profile", f"""WITH {READINGS}, {DRIFT} SELECT site, name, count(DISTINCT b) AS n_blocks, CAST(sum(n) AS BIGINT) AS n_rows FROM moments GROUP BY 1, 2""")
def _(spark, sf):
    long = readings(spark, sf).select("site", "date", F.inline(F.array(
        F.struct(F.lit("people").alias("name"), F.col("people").cast("double").alias("value")), F.struct(F.lit("temp_c").alias("name"), F.col("temp_c").alias("value")))))
    months = long.withColumn("_month", F.trunc("date", "MM")).groupBy("site", "name", "_month").agg(F.count("*").alias("n"))
    blocks = ql.month_blocks(months, date="_month", series=["site", "name"])
    return months.join(blocks, ["site", "name", "_month"]).groupBy("site", "name").agg(
        F.count_distinct("_block").alias("n_blocks"), F.sum("n").alias("n_rows"))
