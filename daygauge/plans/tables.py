"""Projections, filters, joins, aggregates, set operations: the relational part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygauge.functions import scalars as sc
from daygauge.operators import association as asc
from daygauge.operators import comfort as cf
from daygauge.operators import daily as dl
from daygauge.operators import features as ft
from daygauge.operators import gap as gp
from daygauge.operators import order_stats as od
from daygauge.operators import quality as ql
from daygauge.operators import sites as st
from daygauge.operators import text as tx
from daygauge.plans.registry import query, r6
from daygauge.plans.roles import (ANSWERS, HOURS, INTENT, READINGS, SITE_SEVERITY, SITES, TEXTS, WORDS, answers, count_days, day_table,
                                  feature_table, holidays, hours, intent_days, joined_sources, model_table, readings, sql_any, sql_days, sql_rank, sql_features,
                                  table, texts, weather_days, ALL_TEXT, FEATURES)
from daygauge.session import durable
from daygauge.sources import columns as cl
from daygauge.sources import sinks as sk

# ---------------------------------------------------------------- projections and filters


@query("rename_and_coerce", f"""WITH {HOURS}
SELECT station, timestamp, temp_c AS temp, TRY_CAST(CASE WHEN station = 'view' THEN '--' ELSE CAST(CAST(precip_1h_mm AS BIGINT) AS VARCHAR) END AS DOUBLE) AS precip
FROM hours""")
def _(spark, sf):
    raw = hours(spark, sf).select("station", "timestamp", "temp_c", F.when(F.col("station") == "view", "--").otherwise(
        F.col("precip_1h_mm").cast("long").cast("string")).alias("precip_1h_mm"))
    named = cl.rename_missing(raw, {"temp_c": "temp", "precip_1h_mm": "precip", "humidity_pct": "humidity"})
    return named.withColumn("precip", sc.number("precip"))


@query("timestamps_to_days", "SELECT event_id, CAST(ts AS DATE) AS date FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", sc.day_of("ts").alias("date"))


@query("drop_incomplete_rows", f"WITH {TEXTS} SELECT doc_id, satisfaction, inconvenience FROM texts WHERE satisfaction IS NOT NULL AND inconvenience IS NOT NULL")
def _(spark, sf):
    return texts(spark, sf).dropna(subset=["satisfaction", "inconvenience"]).select("doc_id", "satisfaction", "inconvenience")


@query("complete_case_table", f"WITH {sql_features()} SELECT date, count, {', '.join(FEATURES)} FROM model",
       {c: 9 for c in ("precip", "temp", "sun", "wind", "precip_lag1", f"{INTENT}_roll7", "dow_mean_count")})
def _(spark, sf):
    return model_table(spark, sf).select("date", "count", *FEATURES)


@query("text_contains_filter", "SELECT doc_id, lang FROM documents WHERE contains(lang, 'e') AND contains(text, 'ononst')")
def _(spark, sf):
    return table(spark, sf, "documents").where(sc.has_text("lang", "e") & sc.has_text("text", "ononst")).select("doc_id", "lang")


@query("pattern_in_any_column", f"""WITH {TEXTS} SELECT doc_id FROM texts
WHERE coalesce(regexp_matches(location, 'src1$|src2$|zh'), false) OR coalesce(regexp_matches(prefecture, 'src1$|src2$|zh'), false)
   OR coalesce(regexp_matches(inconvenience, 'src1$|src2$|zh'), false)""")
def _(spark, sf):
    return texts(spark, sf).where(sc.matches_any(["location", "prefecture", "inconvenience"], "src1$|src2$|zh")).select("doc_id")


@query("membership_groups", f"""WITH {ANSWERS} SELECT prefecture, count(*) FILTER (WHERE satisfaction IN (1, 2)) AS n_low, count(*) FILTER (WHERE satisfaction IN (4, 5)) AS n_high,
count(*) FILTER (WHERE rating_label IN ('4-NOT SPECIFIED', '5-LOW')) AS n_high_by_label FROM answers GROUP BY 1""")
def _(spark, sf):
    return answers(spark, sf).groupBy("prefecture").agg(
        F.count_if(F.col("satisfaction").isin(*tx.LOW)).alias("n_low"), F.count_if(F.col("satisfaction").isin(*tx.HIGH)).alias("n_high"),
        F.count_if(F.col("rating_label").isin("4-NOT SPECIFIED", "5-LOW")).alias("n_high_by_label"))


@query("threshold_split_means", f"""WITH {sql_days(True)} SELECT site, count(*) FILTER (WHERE wind > 5) AS n_high, count(*) FILTER (WHERE wind <= 5) AS n_normal,
avg(CASE WHEN wind > 5 THEN count END) AS mean_high, avg(CASE WHEN wind <= 5 THEN count END) AS mean_normal FROM days GROUP BY site""",
       r6("mean_high", "mean_normal"))
def _(spark, sf):
    days = day_table(spark, sf, "site")
    return days.groupBy("site").agg(
        F.count_if(F.col("wind") > 5).alias("n_high"), F.count_if(F.col("wind") <= 5).alias("n_normal"),
        F.avg(F.when(F.col("wind") > 5, F.col("count"))).alias("mean_high"), F.avg(F.when(F.col("wind") <= 5, F.col("count"))).alias("mean_normal"))


@query("range_violations", f"""WITH {READINGS} SELECT site, 'temp_c' AS name, count(*) FILTER (WHERE temp_c < -10 OR temp_c > 30) AS n_violations FROM readings GROUP BY 1
UNION ALL SELECT site, 'precip_1h_mm', count(*) FILTER (WHERE precip_1h_mm < 0) FROM readings GROUP BY 1
UNION ALL SELECT site, 'wind_speed_ms', count(*) FILTER (WHERE wind_speed_ms > 8) FROM readings GROUP BY 1""")
def _(spark, sf):
    return ql.range_violations(readings(spark, sf), {"temp_c": (-10, 30), "precip_1h_mm": (0, None), "wind_speed_ms": (None, 8)}, series="site")


@query("month_set_filter", f"""WITH {sql_days()} SELECT CASE WHEN month(date) IN (6, 7, 8) THEN 'summer' ELSE 'winter' END AS season,
count(*) AS n_days, CAST(sum(count) AS BIGINT) AS total FROM days WHERE month(date) IN (6, 7, 8, 12, 1, 2) GROUP BY 1""")
def _(spark, sf):
    month = F.month("date")
    season = F.when(month.isin(6, 7, 8), "summer").when(month.isin(12, 1, 2), "winter")
    return (day_table(spark, sf).withColumn("season", season).where("season is not null").groupBy("season")
            .agg(F.count("*").alias("n_days"), F.sum("count").alias("total")))


@query("column_resolver", "SELECT l_shipdate AS by_name, l_extendedprice AS by_part, l_orderkey AS by_position FROM lineitem")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    picks = {"by_name": cl.find_column(df.columns, names=["ship_date", "l_shipdate", "l_tax"]),
             "by_part": cl.find_column(df.columns, contains=["price"], without=["total"]),
             "by_position": cl.find_column(df.columns, position=0)}
    return df.select(*[F.col(c).alias(n) for n, c in picks.items()])


@query("absent_column_defaults", f"WITH {HOURS} SELECT station, timestamp, 0.0::DOUBLE AS pressure, '' AS remark FROM hours")
def _(spark, sf):
    full = cl.with_defaults(hours(spark, sf), {"pressure": F.lit(0.0), "remark": F.lit(""), "temp_c": F.lit(-1.0)})
    return full.select("station", "timestamp", "pressure", "remark")


@query("label_mapping", """SELECT CASE WHEN contains(r_name, 'ASIA') THEN 'ASIA' WHEN contains(r_name, 'AMER') THEN 'AMER' WHEN contains(r_name, 'EU') THEN 'EU' END AS label,
count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE contains(r_name, 'ASIA') OR contains(r_name, 'AMER') OR contains(r_name, 'EU') GROUP BY 1""")
def _(spark, sf):
    customers = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    regions = customers.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = regions.select(sc.canonical_label("r_name", ["ASIA", "AMER", "EU"]).alias("label"))
    return named.where(F.col("label") != "Other").groupBy("label").agg(F.count("*").alias("n"))


PRIORITY = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "5-LOW": 1}


@query("category_to_number", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 5.0::DOUBLE WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 1 END AS midpoint FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", sc.mapped("o_orderpriority", PRIORITY).cast("double").alias("midpoint"))


# ---------------------------------------------------------------- joins

DAY_DOUBLES = {c: 9 for c in ("precip", "temp", "sun", "wind", "snow_depth", "humidity")}


@query("daily_table", f"WITH {sql_days()} SELECT * FROM days", DAY_DOUBLES)
def _(spark, sf):
    return joined_sources(spark, sf)


@query("daily_table_by_site", f"WITH {sql_days(True)} SELECT * FROM days", DAY_DOUBLES)
def _(spark, sf):
    return day_table(spark, sf, "site")


SITE_MODEL = f"""site_model AS (SELECT site, date, count, {INTENT}, temp, precip, wind, coalesce(snow_depth, 0) AS snow_depth
  FROM counts JOIN weather USING (site, date) JOIN intent USING (date)
  WHERE temp IS NOT NULL AND precip IS NOT NULL AND wind IS NOT NULL)"""


def site_model(spark, sf) -> DataFrame:
    return durable(st.site_model_table(count_days(spark, sf, "site"), weather_days(spark, sf, "site"), intent_days(spark, sf), INTENT))


@query("site_model_table", f"WITH {sql_days(True)}, {SITE_MODEL} SELECT * FROM site_model",
       {c: 9 for c in ("precip", "temp", "wind", "snow_depth")})
def _(spark, sf):
    return site_model(spark, sf).select("site", "date", "count", INTENT, "temp", "precip", "wind", "snow_depth")


@query("flag_left_join", f"""WITH {sql_days()}, marks AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, 1 AS flag FROM orders WHERE o_totalprice > 450000)
SELECT date, count, coalesce(flag, 0) AS flag FROM days LEFT JOIN marks USING (date)""")
def _(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 450000").select(F.to_date("o_orderdate").alias("date"), F.lit(1).alias("flag"))
    return day_table(spark, sf).select("date", "count").join(big.dropDuplicates(), "date", "left").withColumn("flag", F.coalesce("flag", F.lit(0)))


@query("month_dimension_join", """WITH months AS (SELECT unnest(range(1, 15)) AS month), loss AS (
  SELECT CAST(month(o_orderdate) AS BIGINT) AS month, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(month AS INT) AS month, coalesce(n, 0) AS n FROM months LEFT JOIN loss USING (month)""")
def _(spark, sf):
    # Two months more than the calendar has, so that the outer side finds no partner for them.
    months = spark.range(1, 15).select(F.col("id").cast("int").alias("month"))
    loss = (table(spark, sf, "orders").groupBy(F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n")))
    return months.join(loss, "month", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def three_sites(spark, sf) -> DataFrame:
    return st.side_by_side(day_table(spark, sf, "site"), SITES)


WIDE = """wide AS (SELECT a.date, a.count AS count_0, n.count AS count_1, r.count AS count_2, a.wind
  FROM (SELECT * FROM days WHERE site = 'A') a JOIN (SELECT * FROM days WHERE site = 'N') n USING (date)
  JOIN (SELECT * FROM days WHERE site = 'R') r USING (date))"""


@query("sites_side_by_side", f"WITH {sql_days(True)}, {WIDE} SELECT * FROM wide", {"wind": 9})
def _(spark, sf):
    return three_sites(spark, sf)


@query("region_counts_join", f"""WITH {sql_days()}, {ANSWERS},
a AS (SELECT date, count(*) AS n_0 FROM answers WHERE contains(prefecture, 'ASIA') GROUP BY date),
b AS (SELECT date, count(*) AS n_1 FROM answers WHERE contains(prefecture, 'EUROPE') GROUP BY date)
SELECT date, count, n_0, n_1 FROM days LEFT JOIN a USING (date) LEFT JOIN b USING (date) WHERE n_0 IS NOT NULL AND n_1 IS NOT NULL""")
def _(spark, sf):
    counts = st.region_counts(answers(spark, sf), ["ASIA", "EUROPE"])
    return count_days(spark, sf).join(counts, "date", "left").dropna()


@query("survey_weather_join", f"""WITH {sql_days()}, {ANSWERS}, sat AS (SELECT date, avg(satisfaction) AS mean_satisfaction FROM answers GROUP BY date)
SELECT date, temp, mean_satisfaction FROM weather JOIN sat USING (date)""", r6("temp", "mean_satisfaction"))
def _(spark, sf):
    sat = answers(spark, sf).groupBy("date").agg(F.avg("satisfaction").alias("mean_satisfaction"))
    return weather_days(spark, sf).select("date", "temp").join(sat, "date", "inner")


DAILY_SAT = """sat AS (SELECT date, avg(satisfaction) AS mean_satisfaction, count(satisfaction) AS n_responses, avg(nps_raw) AS mean_nps
  FROM answers WHERE contains(prefecture, 'ASIA') GROUP BY date)"""


@query("daily_or_monthly_match", f"""WITH {sql_days()}, {ANSWERS}, {DAILY_SAT}
SELECT date, CAST(count AS DOUBLE) AS count, mean_satisfaction, n_responses, mean_nps FROM days JOIN sat USING (date)""",
       r6("count", "mean_satisfaction", "mean_nps"))
def _(spark, sf):
    return cf.match_satisfaction(count_days(spark, sf), cf.satisfaction_daily(answers(spark, sf), region="ASIA"))


@query("monthly_fallback_match", f"""WITH {sql_days()}, {ANSWERS}, {DAILY_SAT}, m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, avg(count) AS count FROM days GROUP BY 1),
s AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, avg(mean_satisfaction) AS mean_satisfaction, CAST(sum(n_responses) AS BIGINT) AS n_responses, avg(mean_nps) AS mean_nps FROM sat GROUP BY 1)
SELECT date, count, mean_satisfaction, n_responses, mean_nps FROM m JOIN s USING (date)""", r6("count", "mean_satisfaction", "mean_nps"))
def _(spark, sf):
    # More matching days are asked for than any calendar has, so the monthly branch runs.
    return cf.match_satisfaction(count_days(spark, sf), cf.satisfaction_daily(answers(spark, sf), region="ASIA"), min_days=100_000)


@query("keys_not_covered", """SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def _(spark, sf):
    new = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return sk.not_covered(table(spark, sf, "orders"), new, ["o_orderkey"]).select("o_orderkey", "o_custkey")


GAPS = """seen AS (SELECT DISTINCT site, CAST(date AS DATE) AS date FROM (SELECT o_orderpriority || o_orderstatus AS site, o_orderdate AS date FROM orders)),
span AS (SELECT site, min(date) AS lo, max(date) AS hi FROM seen GROUP BY site),
calendar AS (SELECT site, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM span)"""


@query("missing_calendar_days", f"WITH {GAPS} SELECT * FROM calendar ANTI JOIN seen USING (site, date)")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.concat("o_orderpriority", "o_orderstatus").alias("site"), F.to_date("o_orderdate").alias("date"))
    return dl.missing_days(rows, series="site")


@query("value_map_join", """SELECT spending, midpoint, count(*) AS n FROM (SELECT o_orderstatus AS spending FROM orders)
LEFT JOIN (VALUES ('F', 5000.0::DOUBLE), ('O', 20000.0)) AS m(spending, midpoint) USING (spending) GROUP BY 1, 2""")
def _(spark, sf):
    dimension = spark.createDataFrame([("F", 5000.0), ("O", 20000.0)], "spending string, midpoint double")
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("spending"))
    return rows.groupBy("spending").agg(F.count("*").alias("n")).join(dimension, "spending", "left")


@query("holiday_lookup", f"WITH {sql_features()} SELECT date, is_holiday, is_weekend, is_weekend_or_holiday, dow, month FROM calendar")
def _(spark, sf):
    days = ft.add_calendar(count_days(spark, sf), holidays=holidays(spark, sf))
    return days.select("date", "is_holiday", "is_weekend", "is_weekend_or_holiday", "dow", "month")


@query("group_mean_on_rows", f"WITH {sql_features(True)} SELECT site, date, dow, dow_mean_count FROM features", r6("dow_mean_count"))
def _(spark, sf):
    days = ft.add_calendar(count_days(spark, sf, "site"))
    return ft.add_weekday_mean(days, series="site").select("site", "date", "dow", "dow_mean_count")


BLOCKS = """months AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS m FROM days),
blocks AS (SELECT m, CAST(floor((row_number() OVER (ORDER BY m) - 1) / 3) AS INT) AS b FROM months)"""


@query("month_block_pairs", f"""WITH {sql_days()}, {BLOCKS}, totals AS (SELECT b, count(*) AS n_days, CAST(sum(count) AS BIGINT) AS total FROM days JOIN blocks ON m = date_trunc('month', date) GROUP BY b)
SELECT x.b AS block, x.total AS total_a, y.total AS total_b, y.n_days AS days_b FROM totals x JOIN totals y ON y.b = x.b + 1""")
def _(spark, sf):
    days = count_days(spark, sf).withColumn("_month", F.trunc("date", "MM"))
    totals = days.join(ql.month_blocks(days), "_month").groupBy("_block").agg(F.count("*").alias("n_days"), F.sum("count").alias("total"))
    later = totals.select((F.col("_block") - 1).alias("_block"), F.col("total").alias("total_b"), F.col("n_days").alias("days_b"))
    return totals.join(later, "_block").select(F.col("_block").alias("block"), F.col("total").alias("total_a"), "total_b", "days_b")


# ---------------------------------------------------------------- aggregates

@query("hourly_to_daily", f"WITH {sql_days(True)} SELECT * FROM weather", DAY_DOUBLES)
def _(spark, sf):
    return weather_days(spark, sf, "site")


@query("group_sums", f"WITH {READINGS} SELECT site, date, CAST(sum(people) AS BIGINT) AS count FROM readings GROUP BY 1, 2")
def _(spark, sf):
    return count_days(spark, sf, "site")


@query("group_sizes", "SELECT CAST(o_orderdate AS DATE) AS date, o_orderstatus AS site, count(*) AS count FROM orders GROUP BY 1, 2")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("site"))
    return dl.daily_rows(rows, series="site")


@query("non_null_counts_and_means", f"""WITH {ANSWERS} SELECT date, avg(satisfaction) AS mean_satisfaction, count(satisfaction) AS n_responses,
avg(nps_raw) AS mean_nps, avg(satisfaction_service) AS mean_service FROM answers WHERE contains(prefecture, 'ASIA') GROUP BY date""",
       r6("mean_satisfaction", "mean_nps", "mean_service"))
def _(spark, sf):
    return cf.satisfaction_daily(answers(spark, sf), region="ASIA")


@query("monthly_from_daily_means", f"""WITH {ANSWERS}, {DAILY_SAT} SELECT CAST(date_trunc('month', date) AS DATE) AS date, avg(mean_satisfaction) AS mean_satisfaction,
CAST(sum(n_responses) AS BIGINT) AS n_responses, avg(mean_nps) AS mean_nps FROM sat GROUP BY 1""", r6("mean_satisfaction", "mean_nps"))
def _(spark, sf):
    return cf.monthly_satisfaction(cf.satisfaction_daily(answers(spark, sf), region="ASIA"))


@query("days_with_enough_answers", f"""WITH {ANSWERS} SELECT date, location, count(satisfaction) AS n, avg(satisfaction) AS mean_sat FROM answers
GROUP BY 1, 2 HAVING count(satisfaction) >= 3""", r6("mean_sat"))
def _(spark, sf):
    return (answers(spark, sf).groupBy("date", "location").agg(F.count("satisfaction").alias("n"), F.avg("satisfaction").alias("mean_sat"))
            .where("n >= 3"))


@query("weekday_means", f"WITH {sql_features()} SELECT dow, count(*) AS n_days, avg(count) AS mean_count, avg({INTENT}) AS mean_{INTENT} FROM features GROUP BY dow",
       r6("mean_count", f"mean_{INTENT}"))
def _(spark, sf):
    return ft.weekday_profile(ft.add_calendar(day_table(spark, sf)), "count", INTENT)


@query("severity_distribution", f"WITH {sql_features(True)} SELECT site, weather_severity, count(*) AS n FROM features GROUP BY 1, 2")
def _(spark, sf):
    return ft.add_severity(day_table(spark, sf, "site"), **SITE_SEVERITY).groupBy("site", "weather_severity").agg(F.count("*").alias("n"))


@query("medians", f"WITH {sql_days(True)} SELECT site, median(count) AS count_median, median({INTENT}) AS intent_median FROM days GROUP BY site")
def _(spark, sf):
    return day_table(spark, sf, "site").groupBy("site").agg(F.median("count").alias("count_median"), F.median(INTENT).alias("intent_median"))


@query("quartiles_of_raw_values", """SELECT l_returnflag AS site, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS q50, quantile_cont(l_extendedprice, 0.75) AS q75
FROM lineitem GROUP BY 1""", r6("q25", "q50", "q75"))
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("site"), F.col("l_extendedprice").alias("value"))
    return od.exact_quantiles(rows, ["site"], "value", (0.25, 0.5, 0.75), ("q25", "q50", "q75"))


@query("moments", f"WITH {READINGS} SELECT site, avg(temp_c) AS mean, stddev_samp(temp_c) AS std, min(temp_c) AS min, max(temp_c) AS max FROM readings GROUP BY site",
       r6("mean", "std"))
def _(spark, sf):
    return readings(spark, sf).groupBy("site").agg(F.avg("temp_c").alias("mean"), F.stddev_samp("temp_c").alias("std"),
                                                   F.min("temp_c").alias("min"), F.max("temp_c").alias("max"))


@query("missing_share", f"""WITH {READINGS} SELECT site, count(*) AS n_total, count(*) FILTER (WHERE snow_depth_cm IS NULL) AS n_missing,
round_even(count(*) FILTER (WHERE snow_depth_cm IS NULL) / greatest(count(*), 1) * 100, 2) AS pct_missing FROM readings GROUP BY site""")
def _(spark, sf):
    missing = F.count_if(F.col("snow_depth_cm").isNull())
    return readings(spark, sf).groupBy("site").agg(
        F.count("*").alias("n_total"), missing.alias("n_missing"),
        F.bround(missing / F.greatest(F.count("*"), F.lit(1)) * 100, 2).alias("pct_missing"))


@query("region_profile", f"WITH {ANSWERS} SELECT count(*) AS n_total, count(*) FILTER (WHERE town IS NULL) AS n_missing, round_even(count(*) FILTER (WHERE town IS NULL) / greatest(count(*), 1) * 100, 2) AS pct_missing, count(DISTINCT town) AS n_distinct FROM answers")
def _(spark, sf):
    return ql.region_profile(answers(spark, sf), "town")


CORR_COLUMNS = ["count", INTENT, f"{INTENT}_lag2", f"{INTENT}_roll7", "precip", "temp", "sun", "wind", "is_weekend_or_holiday",
                "weather_severity", "dow_mean_count"]


def sql_pairs(source: str, columns: list[str], by: str = "") -> str:
    key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return "\nUNION ALL ".join(
        f"SELECT {key}'{a}' AS col_a, '{b}' AS col_b, CASE WHEN isfinite(corr({a}, {b})) THEN corr({a}, {b}) END AS r, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {source}{group}"
        for i, a in enumerate(columns) for b in columns[i + 1:])


@query("pearson_by_site", f"WITH {sql_days(True)} SELECT site, corr(count, {INTENT}) AS r FROM days GROUP BY site", r6("r"))
def _(spark, sf):
    return day_table(spark, sf, "site").groupBy("site").agg(sc.pearson("count", INTENT).alias("r"))


@query("correlation_matrix", f"WITH {sql_features()} {sql_pairs('features', CORR_COLUMNS)}", r6("r"))
def _(spark, sf):
    return asc.correlation_pairs(feature_table(spark, sf), CORR_COLUMNS)


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]
REGION_DAYS = "wide AS (SELECT date, " + ", ".join(
    f"count(*) FILTER (WHERE contains(prefecture, '{r}')) AS {r}" for r in REGIONS) + " FROM answers WHERE " + " OR ".join(
    f"contains(prefecture, '{r}')" for r in REGIONS) + " GROUP BY date)"


@query("region_correlation", f"WITH {ANSWERS}, {REGION_DAYS} {sql_pairs('wide', REGIONS)}", r6("r"))
def _(spark, sf):
    return asc.correlation_pairs(st.region_day_table(answers(spark, sf), REGIONS), REGIONS)


@query("demand_by_month_and_region", f"WITH {ANSWERS} SELECT strftime(date, '%Y-%m') AS month, " + ", ".join(
    f"count(*) FILTER (WHERE contains(prefecture, '{r}')) AS {r}" for r in REGIONS) + " FROM answers WHERE " + " OR ".join(
    f"contains(prefecture, '{r}')" for r in REGIONS) + " GROUP BY 1")
def _(spark, sf):
    return st.demand_table(answers(spark, sf), REGIONS)


@query("positive_part_sum", f"""WITH {sql_days(True)} SELECT site, sum(greatest(600.0::DOUBLE - count, 0)) AS shortfall, sum(greatest(count - 600.0::DOUBLE, 0)) AS excess FROM days GROUP BY site""",
       r6("shortfall", "excess"))
def _(spark, sf):
    days = count_days(spark, sf, "site").withColumn("predicted", F.lit(600.0))
    over = F.sum(F.greatest(F.col("count") - F.col("predicted"), F.lit(0.0))).alias("excess")
    return gp.shortfall(days, series="site").withColumnRenamed("lost_visitors", "shortfall").join(days.groupBy("site").agg(over), "site")


@query("keyword_share", f"""WITH {TEXTS} SELECT prefecture, count(*) AS n, count(*) FILTER (WHERE {sql_any('reason', WORDS)}) AS hits,
CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE {sql_any('reason', WORDS)}) * 100.0::DOUBLE / count(*) ELSE 0 END AS pct FROM texts GROUP BY prefecture""", r6("pct"))
def _(spark, sf):
    hit = sc.contains_any("reason", WORDS)
    out = texts(spark, sf).groupBy("prefecture").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    return out.withColumn("pct", sc.percent_of(F.col("hits"), F.col("n")))


@query("relative_to_largest", f"""WITH {sql_days(True)} SELECT site, date, count, count * 100.0::DOUBLE / max(count) OVER () AS relative,
count * 100.0::DOUBLE / max(count) OVER (PARTITION BY site) AS relative_in_site FROM days""", r6("relative", "relative_in_site"))
def _(spark, sf):
    ranked = st.heat_rank(count_days(spark, sf, "site"), "count", series=["site", "date"])
    return ranked.withColumn("relative_in_site", tx.relative_to_max("count", series="site"))


@query("weekday_five_numbers", f"""WITH {sql_features()} SELECT dow, quantile_cont(count, 0) AS minimum, quantile_cont(count, 0.25) AS q25, quantile_cont(count, 0.5) AS median,
quantile_cont(count, 0.75) AS q75, quantile_cont(count, 1) AS maximum FROM features GROUP BY dow""", r6("minimum", "q25", "median", "q75", "maximum"))
def _(spark, sf):
    return ft.weekday_spread(ft.add_calendar(count_days(spark, sf)))


@query("source_coverage", f"""WITH {READINGS}, {ANSWERS}
SELECT 'readings' AS source_name, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows FROM readings
UNION ALL SELECT 'answers', min(date), max(date), count(*) FROM answers
UNION ALL SELECT 'events', min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), count(*) FROM events""")
def _(spark, sf):
    events = table(spark, sf, "events").select(F.to_date("ts").alias("date"))
    return ql.source_coverage({"readings": readings(spark, sf), "answers": answers(spark, sf), "events": events})


# ---------------------------------------------------------------- windows, sorts, sets

@query("rolling_means", f"WITH {sql_features(True)} SELECT site, date, {INTENT}_roll3, {INTENT}_roll7, {INTENT}_roll14 FROM features",
       r6(f"{INTENT}_roll3", f"{INTENT}_roll7", f"{INTENT}_roll14"))
def _(spark, sf):
    return ft.add_rolling(day_table(spark, sf, "site"), INTENT, series="site").select("site", "date", *[f"{INTENT}_roll{n}" for n in (3, 7, 14)])


LAGS = [f"{INTENT}_lag{k}" for k in range(8)]


@query("positional_lags", f"WITH {sql_features(True)} SELECT site, date, {', '.join(LAGS)}, precip_lag1, temp_lag1 FROM features", r6("precip_lag1", "temp_lag1"))
def _(spark, sf):
    return ft.add_lags(day_table(spark, sf, "site"), INTENT, series="site").select("site", "date", *LAGS, "precip_lag1", "temp_lag1")


@query("calendar_lag", """WITH c AS (SELECT l_suppkey AS site, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS count FROM lineitem GROUP BY 1, 2),
span AS (SELECT site, min(date) AS lo, max(date) AS hi FROM c GROUP BY site),
spine AS (SELECT site, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
s AS (SELECT site, date, count, lag(count, 1) OVER (PARTITION BY site ORDER BY date) AS yesterday FROM spine LEFT JOIN c USING (site, date))
SELECT * FROM s""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("site"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").cast("long").alias("people"))
    spine = ft.on_calendar(dl.daily_sum(rows, "people", series="site"), series="site")
    return spine.select("site", "date", "count", ft.shifted("count", 1, ft.ordered("site")).alias("yesterday"))


@query("signed_shifts", f"""WITH {sql_days(True)} SELECT site, date, lead(count, 3) OVER w AS shift_m3, lead(count, 1) OVER w AS shift_m1, count AS shift_0, lag(count, 7) OVER w AS shift_7
FROM days WINDOW w AS (PARTITION BY site ORDER BY date)""")
def _(spark, sf):
    w = ft.ordered("site")
    return count_days(spark, sf, "site").select("site", "date", *[
        ft.shifted("count", k, w).alias(f"shift_{'m' if k < 0 else ''}{abs(k)}") for k in (-3, -1, 0, 7)])


@query("average_ranks", f"""WITH {sql_days(True)} SELECT site, date, {sql_rank('count', 'site')} AS rank FROM days""", r6("rank"))
def _(spark, sf):
    return count_days(spark, sf, "site").select("site", "date", asc.average_rank("count", ["site"]).alias("rank"))


@query("keep_first_and_last", """SELECT user_id, min(event_id) AS first_event, max(event_id) AS last_event FROM events GROUP BY user_id""")
def _(spark, sf):
    from daygauge.sources.intent import keep_first
    events = table(spark, sf, "events").select("user_id", "event_id", "ts")
    first = keep_first(events, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_id").alias("first_event"))
    last = sk.keep_last(events, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_id").alias("last_event"))
    return first.join(last, "user_id")


@query("top_gap_days", f"""WITH {sql_days()}, m AS (SELECT median({INTENT}) AS mi, median(count) AS mc FROM days)
SELECT date, count, {INTENT}, precip FROM days, m WHERE coalesce({INTENT} > mi, false) AND count < mc ORDER BY {INTENT} DESC, date LIMIT 10""", r6("precip"))
def _(spark, sf):
    return gp.top_gap_days(gp.opportunity_gap(day_table(spark, sf), INTENT), INTENT).select("date", "count", INTENT, "precip")


@query("union_of_differing_headers", """SELECT 'event' AS kind, event_id AS id, value AS amount, CAST(NULL AS VARCHAR) AS role FROM events
UNION ALL SELECT 'order', o_orderkey, o_totalprice, NULL FROM orders
UNION ALL SELECT 'turn', conv_id, NULL, role FROM conversations""")
def _(spark, sf):
    parts = [table(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("value").alias("amount")),
             table(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount")),
             table(spark, sf, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), "role")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@query("distinct_days", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem")
def _(spark, sf):
    return readings(spark, sf).select("date").distinct()


@query("schema_difference", f"""WITH {HOURS} SELECT 'missing' AS kind, 'gust_ms' AS name, CAST(0 AS BIGINT) AS n_values UNION ALL SELECT 'missing', 'pressure_hpa', 0
UNION ALL SELECT 'extra', 'station', count(station) FROM hours UNION ALL SELECT 'extra', 'snow_depth_cm', count(snow_depth_cm) FROM hours
UNION ALL SELECT 'extra', 'sun_1h_h', count(sun_1h_h) FROM hours""")
def _(spark, sf):
    rows = hours(spark, sf)
    missing, extra = ql.schema_diff(rows.columns, ["timestamp", "temp_c", "precip_1h_mm", "wind_speed_ms", "humidity_pct", "gust_ms", "pressure_hpa"])
    # A column nobody expects is reported with the number of values it holds.
    lost = [F.struct(F.lit("missing").alias("kind"), F.lit(c).alias("name"), F.lit(0).cast("long").alias("n_values")) for c in missing]
    found = [F.struct(F.lit("extra").alias("kind"), F.lit(c).alias("name"), F.count(c).alias("n_values")) for c in extra]
    return rows.agg(F.array(*lost, *found).alias("_d")).select(F.inline("_d"))


# ---------------------------------------------------------------- scalar functions

@query("text_functions", f"""WITH {TEXTS} SELECT doc_id, {ALL_TEXT} AS joined, length(trim({ALL_TEXT}, ' ')) AS n_chars,
TRY_CAST(regexp_extract(location, '(\\d+)', 1) AS DOUBLE) AS digits, coalesce({sql_any(ALL_TEXT, WORDS)}, false) AS any_word,
CASE {' '.join(f"WHEN contains({ALL_TEXT}, '{w}') THEN '{w}'" for w in WORDS)} END AS first_word, substr(reason, 1, 20) AS excerpt FROM texts""")
def _(spark, sf):
    joined = sc.joined_text(["reason", "inconvenience", "freetext"])
    return texts(spark, sf).select(
        "doc_id", joined.alias("joined"), F.length(F.trim(joined)).cast("long").alias("n_chars"), sc.first_number("location").alias("digits"),
        sc.contains_any(joined, WORDS).alias("any_word"), sc.first_word(joined, WORDS).alias("first_word"),
        F.substring("reason", 1, 20).alias("excerpt"))


@query("date_functions", """SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INT) AS dow, CAST(month(o_orderdate) AS INT) AS month, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
strftime(o_orderdate, '%Y-%m-%d') AS text, o_orderdate + INTERVAL 24 HOUR AS midnight_after FROM orders""")
def _(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.weekday(d).alias("dow"), F.month(d).alias("month"), F.trunc(d, "MM").alias("period"),
        F.date_format(d, "yyyy-MM-dd").alias("text"), sc.hour_ending(d, F.lit(24)).alias("midnight_after"))


@query("math_functions", """SELECT l_orderkey, l_linenumber, least(l_quantity, 30) AS clipped, pow(l_quantity, 0.16) AS root, CAST(trunc(l_tax * 12) AS INT) AS whole,
round_even(l_quantity / 4, 1) AS even, CASE WHEN l_discount > 0 THEN l_tax / l_discount END AS finite FROM lineitem""", r6("root", "finite"))
def _(spark, sf):
    ratio = F.when(F.col("l_discount") > 0, F.col("l_tax") / F.when(F.col("l_discount") > 0, F.col("l_discount"))).otherwise(F.lit(float("inf")))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.least("l_quantity", F.lit(30.0)).alias("clipped"), F.pow("l_quantity", F.lit(0.16)).alias("root"),
        (F.col("l_tax") * 12).cast("int").alias("whole"), F.bround(F.col("l_quantity") / 4, 1).alias("even"), sc.finite_or_null(ratio).alias("finite"))


@query("fixed_bins", f"""WITH {sql_days(True)} SELECT site, date, CASE WHEN count > 0 AND count <= 150 THEN 'few' WHEN count > 150 AND count <= 250 THEN 'some' WHEN count > 250 AND count <= 400 THEN 'many' END AS bin FROM days""")
def _(spark, sf):
    return count_days(spark, sf, "site").select("site", "date", sc.cut("count", (0, 150, 250, 400), ("few", "some", "many")).alias("bin"))


@query("quantile_bins", f"""WITH {sql_days(True)}, e AS (SELECT site, list_distinct(quantile_cont(count, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS u FROM days GROUP BY site),
s AS (SELECT site, list_sort(u) AS u FROM e),
b AS (SELECT site, date, count, u, len(list_filter(u[2:len(u) - 1], lambda x: x < count)) + 1 AS k FROM days JOIN s USING (site))
SELECT site, date, u[k] AS lo, u[k + 1] AS hi, (u[k] + u[k + 1]) / 2 AS mid FROM b""", r6("lo", "hi", "mid"))
def _(spark, sf):
    binned = cf.quantile_bins(count_days(spark, sf, "site"), "count", series="site")
    return binned.select("site", "date", F.col("bin.left").alias("lo"), F.col("bin.right").alias("hi"), F.col("bin.mid").alias("mid"))


@query("fill_from_other_column", f"WITH {ANSWERS} SELECT o_orderkey, coalesce(satisfaction_service, satisfaction) AS rating FROM answers")
def _(spark, sf):
    return answers(spark, sf).select("o_orderkey", F.coalesce("satisfaction_service", "satisfaction").alias("rating"))


@query("rows_per_rank", f"WITH {sql_days(True)} SELECT site, date, count, row_number() OVER (PARTITION BY site ORDER BY abs(count - 300) DESC, date) AS rank FROM days")
def _(spark, sf):
    days = count_days(spark, sf, "site").withColumn("off", F.col("count") - 300)
    return sk.rank_by_size(days, "off", "date", series="site").select("site", "date", "count", F.col("rank").cast("long").alias("rank"))
