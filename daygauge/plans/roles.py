"""The tables every query works on, derived from the given tables, as DataFrames and as SQL.

Readings (counter and weather, several a day and site) come from line items, intent from orders, answers of a survey
from orders with their customers' regions, free text from documents with labels, hours from events. Measures are whole
numbers, so that sums do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygauge.operators.association import RANK_DECIMALS
from daygauge.operators import daily as dl
from daygauge.operators import features as ft
from daygauge.session import durable

SITES = ("A", "N", "R")
INTENT = "directions"
HOLIDAYS = ("01-01", "02-11", "04-29", "05-03", "05-04", "05-05", "11-03", "11-23")
WORDS = ("ononst", "thatin", "orre", "rewh", "eau")
CROWD_WORDS = ("thatin", "orre")
QUIET_WORDS = ("ononst", "rewh")
RANKS = {1: (47, 35.0), 2: (46, 40.0), 3: (47, 30.0), 4: (45, 25.0), 5: (44, 20.0), 6: (47, 38.0), 7: (45, 15.0), 8: (40, 0.0),
         9: (46, 22.0), 10: (47, 30.0), 11: (46, 35.0), 12: (47, 38.0)}
# Severity thresholds in the units of the derived readings, for all sites together and for one site.
SEVERITY = {"light": 80.0, "heavy": 100.0, "strong": 5.2}
SITE_SEVERITY = {"light": 25.0, "heavy": 40.0, "strong": 5.2}
SPEND, USD_RATE = 13811.0, 157.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("site"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").cast("long").alias("people"),
        (F.col("l_quantity") - 15).alias("temp_c"), F.floor(F.col("l_tax") * 100 + 0.5).cast("double").alias("precip_1h_mm"),
        F.floor(F.col("l_discount") * 100 + 0.5).cast("double").alias("wind_speed_ms"),
        F.floor(F.col("l_extendedprice") / 10000).cast("double").alias("sun_1h_h"),
        (30 + 8.0 * F.col("l_linenumber")).alias("humidity_pct"),
        F.when(F.col("l_linestatus") == "F", F.floor(F.col("l_quantity") / 10).cast("double")).alias("snow_depth_cm"))


READINGS = """readings AS (
  SELECT l_returnflag AS site, CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS BIGINT) AS people,
         l_quantity - 15 AS temp_c, floor(l_tax * 100 + 0.5) AS precip_1h_mm, floor(l_discount * 100 + 0.5) AS wind_speed_ms,
         floor(l_extendedprice / 10000) AS sun_1h_h, 30 + 8.0::DOUBLE * l_linenumber AS humidity_pct,
         CASE WHEN l_linestatus = 'F' THEN floor(l_quantity / 10) END AS snow_depth_cm
  FROM lineitem)"""

MEANS = {"temp_c": "temp", "sun_1h_h": "sun", "wind_speed_ms": "wind", "snow_depth_cm": "snow_depth", "humidity_pct": "humidity"}


def count_days(spark, sf_dir, series=None) -> DataFrame:
    return dl.daily_sum(readings(spark, sf_dir), "people", series=series)


def weather_days(spark, sf_dir, series=None) -> DataFrame:
    return dl.daily_measures(readings(spark, sf_dir), series=series, sums={"precip_1h_mm": "precip"}, means=MEANS)


def intent_days(spark, sf_dir) -> DataFrame:
    return dl.daily_rows(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")), out=INTENT)


def holidays(spark, sf_dir) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    return days.where(F.date_format("date", "MM-dd").isin(*HOLIDAYS)).distinct()


def day_readings(spark, sf_dir, series=None) -> DataFrame:
    """Counts and weather in one pass, since both come from the same readings."""
    days = dl.daily_measures(readings(spark, sf_dir), series=series, sums={"people": "count", "precip_1h_mm": "precip"}, means=MEANS)
    return days.withColumn("count", F.col("count").cast("long"))


def day_table(spark, sf_dir, series=None) -> DataFrame:
    """Counts with weather and intent."""
    return dl.join_daily(day_readings(spark, sf_dir, series), intent_days(spark, sf_dir), series=series)


def landed_days(spark, sf_dir, series=None) -> DataFrame:
    """The day table written once, for queries that pass over it several times: the raw tables are read a single time."""
    return durable(day_table(spark, sf_dir, series))


def joined_sources(spark, sf_dir, series=None) -> DataFrame:
    """The same table by joining three sources, each reduced to days on its own."""
    return dl.join_daily(count_days(spark, sf_dir, series), weather_days(spark, sf_dir, series), intent_days(spark, sf_dir), series=series)


def feature_table(spark, sf_dir, series=None) -> DataFrame:
    return ft.build_features(day_table(spark, sf_dir, series), INTENT, series=series, holidays=holidays(spark, sf_dir),
                             **(SITE_SEVERITY if series else SEVERITY))


FEATURES = [INTENT, f"{INTENT}_lag1", f"{INTENT}_lag2", f"{INTENT}_lag3", f"{INTENT}_roll7", "precip", "temp", "sun", "wind",
            "precip_lag1", "is_weekend_or_holiday", "weather_severity", "dow_mean_count", "weekend_x_severity",
            "weekend_x_intent", "month"]
FEW = [INTENT, "precip", "temp", "wind"]


def model_table(spark, sf_dir, series=None) -> DataFrame:
    return ft.complete_cases(feature_table(spark, sf_dir, series), "count", FEATURES)


def _by(series: bool) -> str:
    return "site, " if series else ""


def sql_days(series: bool = False) -> str:
    """CTEs up to ``days``: counts, weather and intent joined."""
    by = _by(series)
    on = "USING (site, date)" if series else "USING (date)"
    return f"""{READINGS},
counts AS (SELECT {by}date, CAST(sum(people) AS BIGINT) AS count FROM readings GROUP BY {by}date),
weather AS (SELECT {by}date, coalesce(sum(precip_1h_mm), 0) AS precip, avg(temp_c) AS temp, avg(sun_1h_h) AS sun,
  avg(wind_speed_ms) AS wind, avg(snow_depth_cm) AS snow_depth, avg(humidity_pct) AS humidity FROM readings GROUP BY {by}date),
intent AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS {INTENT} FROM orders GROUP BY 1),
days AS (SELECT * FROM counts LEFT JOIN weather {on} LEFT JOIN intent USING (date) WHERE count IS NOT NULL)"""


def sql_features(series: bool = False) -> str:
    """CTEs up to ``features`` (all rows) and ``model`` (complete cases)."""
    part = "PARTITION BY site " if series else ""
    w = f"OVER ({part}ORDER BY date)"
    lags = ",\n  ".join([f"lag({INTENT}, {k}) {w} AS {INTENT}_lag{k}" for k in range(8)])
    rolls = ",\n  ".join([f"avg({INTENT}) OVER ({part}ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {INTENT}_roll{n}"
                          for n in (3, 7, 14)])
    dow_part = "site, dow" if series else "dow"
    marks = ", ".join(f"'{h}'" for h in HOLIDAYS)
    cut = SITE_SEVERITY if series else SEVERITY
    missing = " AND ".join(f"{c} IS NOT NULL" for c in ["date", "count", *FEATURES])
    return f"""{sql_days(series)},
holidays AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, 1 AS h FROM orders WHERE strftime(o_orderdate, '%m-%d') IN ({marks})),
calendar AS (SELECT days.*, CAST(coalesce(h, 0) AS INT) AS is_holiday, CAST(isodow(date) - 1 AS INT) AS dow,
  CAST(isodow(date) >= 6 AS INT) AS is_weekend, greatest(CAST(isodow(date) >= 6 AS INT), CAST(coalesce(h, 0) AS INT)) AS is_weekend_or_holiday,
  CAST(month(date) AS INT) AS month,
  CAST(coalesce(precip > {cut['light']}, false) AS INT) + CAST(coalesce(precip > {cut['heavy']}, false) AS INT) + CAST(coalesce(wind > {cut['strong']}, false) AS INT) AS weather_severity
  FROM days LEFT JOIN holidays USING (date)),
features AS (SELECT *, {rolls},
  {lags},
  lag(precip, 1) {w} AS precip_lag1, lag(temp, 1) {w} AS temp_lag1,
  is_weekend_or_holiday * weather_severity AS weekend_x_severity, is_weekend_or_holiday * coalesce({INTENT}, 0) AS weekend_x_intent,
  avg(count) OVER (PARTITION BY {dow_part}) AS dow_mean_count FROM calendar),
model AS (SELECT * FROM features WHERE {missing})"""


# ---------------------------------------------------------------- survey of numbers

def answers(spark, sf_dir) -> DataFrame:
    """One answer per order: region, day, segment, rating 1..5, recommendation 0..9, spending class."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    regions = table(spark, sf_dir, "region")
    rows = (orders.join(customers, orders.o_custkey == customers.c_custkey, "left")
            .join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left"))
    return rows.select(
        "o_orderkey", F.to_date("o_orderdate").alias("date"), F.col("r_name").alias("prefecture"), F.col("n_name").alias("town"),
        F.col("c_mktsegment").alias("location"), F.col("o_orderpriority").alias("rating_label"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("satisfaction"),
        F.floor(F.col("o_totalprice") / 50000).cast("double").alias("nps_raw"),
        F.when(F.col("o_orderstatus") != "P", F.lit(3.0)).alias("satisfaction_service"), F.col("o_orderstatus").alias("spending"))


ANSWERS = """answers AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, r_name AS prefecture, n_name AS town, c_mktsegment AS location,
         o_orderpriority AS rating_label, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS satisfaction,
         floor(o_totalprice / 50000) AS nps_raw, CASE WHEN o_orderstatus <> 'P' THEN 3.0::DOUBLE END AS satisfaction_service,
         o_orderstatus AS spending
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey)"""


# ---------------------------------------------------------------- survey of texts

def texts(spark, sf_dir) -> DataFrame:
    """One free-text answer per document; labelled ones carry a rating of 1 or 5. The day follows the document number."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows = docs.join(labels, "doc_id", "left")
    return rows.select(
        "doc_id", F.col("lang").alias("prefecture"), F.col("source").alias("location"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("date"),
        F.when(F.col("quality") == 1, F.lit(5.0)).when(F.col("quality") == 0, F.lit(1.0)).alias("satisfaction"),
        F.col("text").alias("reason"), F.when(F.col("toxic") == 1, F.col("source")).alias("inconvenience"),
        F.lit(None).cast("string").alias("freetext"))


TEXTS = """texts AS (
  SELECT doc_id, lang AS prefecture, source AS location, DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS date,
         CASE WHEN quality = 1 THEN 5.0::DOUBLE WHEN quality = 0 THEN 1.0::DOUBLE END AS satisfaction, text AS reason,
         CASE WHEN toxic = 1 THEN source END AS inconvenience, CAST(NULL AS VARCHAR) AS freetext
  FROM documents LEFT JOIN labels USING (doc_id))"""

ALL_TEXT = "coalesce(reason, '') || ' ' || coalesce(inconvenience, '') || ' ' || coalesce(freetext, '')"


def sql_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


# ---------------------------------------------------------------- hours

def hours(spark, sf_dir) -> DataFrame:
    """Hourly station rows from events, one station per event type."""
    events = table(spark, sf_dir, "events")
    return (events.groupBy(F.col("event_type").alias("station"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp"))
            .agg(F.max(F.floor("value")).cast("double").alias("temp_c"), F.count("*").cast("double").alias("precip_1h_mm"),
                 F.min(F.floor("value")).cast("double").alias("wind_speed_ms"),
                 F.count_if(F.col("value") > 20).cast("double").alias("sun_1h_h"),
                 F.max(F.when(F.col("value") > 50, F.floor(F.col("value") / 10))).cast("double").alias("snow_depth_cm"),
                 (F.max(F.col("user_id")) + 20).cast("double").alias("humidity_pct")))


HOURS = """hours AS (
  SELECT event_type AS station, date_trunc('hour', ts) AS timestamp, CAST(max(floor(value)) AS DOUBLE) AS temp_c,
         CAST(count(*) AS DOUBLE) AS precip_1h_mm, CAST(min(floor(value)) AS DOUBLE) AS wind_speed_ms,
         CAST(count(*) FILTER (WHERE value > 20) AS DOUBLE) AS sun_1h_h,
         CAST(max(CASE WHEN value > 50 THEN floor(value / 10) END) AS DOUBLE) AS snow_depth_cm,
         CAST(max(user_id) + 20 AS DOUBLE) AS humidity_pct
  FROM events GROUP BY 1, 2)"""


# ---------------------------------------------------------------- SQL helpers for statistics

def sql_t_p(t: str, df: str, steps: int = 4000) -> str:
    """Two-sided t tail: with t = sqrt(df) tan(a) the density is proportional to cos(a)^(df-1); Simpson's rule to pi/2."""
    a = f"atan(abs({t}) / sqrt({df}))"
    h = f"((pi() / 2 - {a}) / {steps})"
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = f"(SELECT sum({weight} * pow(greatest(cos({a} + i * {h}), 0), {df} - 1)) FROM range({steps + 1}) AS s(i)) * {h} / 3"
    return f"2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()) * ({area})"


def sql_rank(column: str, by: str = "") -> str:
    """Average rank of values that agree to RANK_DECIMALS decimals."""
    key, part = f"round(({column})::DOUBLE, {RANK_DECIMALS})", f"PARTITION BY {by} " if by else ""
    ties = f"PARTITION BY {by}, {key}" if by else f"PARTITION BY {key}"
    return f"rank() OVER ({part}ORDER BY {key}) + (count(*) OVER ({ties}) - 1) / 2.0::DOUBLE"


def sql_corr_p(r: str, n: str) -> str:
    return sql_t_p(f"({r} * sqrt(({n} - 2) / ((1 - {r}) * (1 + {r}))))", f"({n} - 2)")


def sql_ols(source: str, target: str, features: list[str], by: list[str] | None = None, name: str = "fit", sweep: int | None = None) -> str:
    """CTEs that solve a regression by sweeping the centred cross-product matrix, one CTE per regressor.

    The last one, ``name``, has n, b0.., v1.. (unscaled variances), m0.. (means), sse, sst per group. ``sweep`` limits
    the model to the first regressors.
    """
    by = by or []
    k = len(features) if sweep is None else sweep
    names = [*features[:k], target]
    key = "".join(f"{b}, " for b in by)
    on = f" JOIN {name}_m USING ({', '.join(by)})" if by else f", {name}_m"
    group = f" GROUP BY {', '.join(by)}" if by else ""
    means = ", ".join(f"avg({c}::DOUBLE) AS m{i}" for i, c in enumerate(names))
    cells = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    cross = ", ".join(f"sum(({names[i]} - m{i}) * ({names[j]} - m{j})) AS a{i}_{j}" for i, j in cells)
    out = [f"{name}_m AS (SELECT {key}count(*) AS n, {means} FROM {source}{group})",
           f"{name}_s0 AS (SELECT {key}any_value(n) AS n, {', '.join(f'any_value(m{i}) AS m{i}' for i in range(k + 1))}, {cross}, "
           f"sum(({target} - m{k}) * ({target} - m{k})) AS sst FROM {source}{on}{group})"]

    def cell(i, j):
        return f"a{min(i, j)}_{max(i, j)}"

    carried = key + "n, sst, " + ", ".join(f"m{i}" for i in range(k + 1))
    for p in range(k):
        d = cell(p, p)
        new = []
        for i, j in cells:
            if i == p and j == p:
                new.append(f"-1 / {d} AS {cell(i, j)}")
            elif i == p or j == p:
                new.append(f"{cell(i, j)} / {d} AS {cell(i, j)}")
            else:
                new.append(f"{cell(i, j)} - {cell(i, p)} * {cell(j, p)} / {d} AS {cell(i, j)}")
        out.append(f"{name}_s{p + 1} AS (SELECT {carried}, {', '.join(new)} FROM {name}_s{p})")
    slopes = ", ".join(f"{cell(i, k)} AS b{i + 1}" for i in range(k))
    variances = ", ".join(f"-{cell(i, i)} AS v{i + 1}" for i in range(k))
    intercept = f"m{k}" + "".join(f" - {cell(i, k)} * m{i}" for i in range(k))
    v0 = "1.0 / n" + "".join(f" - m{i} * m{j} * {cell(i, j)}" for i in range(k) for j in range(k))
    extra = f", {slopes}, {variances}" if k else ""
    out.append(f"{name} AS (SELECT {carried}, {intercept} AS b0, {v0} AS v0{extra}, {cell(k, k)} AS sse, {k} AS k FROM {name}_s{k})")
    return ",\n".join(out)


def sql_terms(features: list[str], name: str = "fit", by: list[str] | None = None) -> str:
    """Rows (by..., term, coef, se, t, df, n, r2, adj_r2) of a ``sql_ols`` result."""
    key = "".join(f"{b}, " for b in by or [])
    parts = []
    for i, term in enumerate(["const", *features]):
        parts.append(f"SELECT {key}'{term}' AS term, b{i} AS coef, sqrt(v{i} * sse / (n - k - 1)) AS se, "
                     f"b{i} / sqrt(v{i} * sse / (n - k - 1)) AS t, n - k - 1 AS df, n, 1 - sse / sst AS r2, "
                     f"1 - (sse / sst) * (n - 1) / (n - k - 1) AS adj_r2 FROM {name}")
    return "\nUNION ALL ".join(parts)


def sql_predicted(features: list[str], name: str = "fit") -> str:
    return "b0" + "".join(f" + b{i} * {c}" for i, c in enumerate(features, start=1))
