"""File sources and sinks: Spark first writes messy files from the given tables, then the readers read them back."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygauge.operators import daily as dl
from daygauge.operators import quality as ql
from daygauge.plans.registry import query, r6
from daygauge.plans.roles import HOURS, INTENT, READINGS, TEXTS, hours, readings, table, texts
from daygauge.plans.statistics import DRIFT_STEPS, DRIFT_TESTS
from daygauge.session import at_once, durable, scratch_path
from daygauge.sources import audits, counters, intent, sinks, station, survey, weather
from daygauge.sources.columns import file_audit, locate_header, read_cells
from daygauge.streaming import incremental

DAY_IN_PATH = r"day=(\d{4}-\d{2}-\d{2})"
TYPE_IN_PATH = r"kind=([^/]+)/"


def write_counter_files(spark, sf) -> str:
    """Counter files by event type and day, in two column orders, next to files of another kind by day; silent hours as 0."""
    root = scratch_path(spark, "counter")
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("kind"), F.to_date("ts").alias("day"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("aggregate from"),
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("aggregate to"), F.floor(F.greatest(F.col("value") - 60, F.lit(0.0))).cast("long").alias("total count"))
    early, late = rows.where("day < '2024-01-15'"), rows.where("day >= '2024-01-15'").select(
        "kind", "day", "total count", F.lit("x").alias("note"), "aggregate to", "aggregate from")
    for part in (early, late):
        part.repartition("kind", "day").write.mode("append").option("header", True).partitionBy("kind", "day").csv(root)
    other = table(spark, sf, "orders").groupBy(F.lit("other").alias("kind"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("orders"))
    # One short row a file, thousands of files: a fixed number keeps the planner from putting them all into one task.
    other.repartition(spark.sparkContext.defaultParallelism, "day").write.mode("append").option("header", True).partitionBy("kind", "day").csv(root)
    return root


COUNTERS = "files AS (SELECT event_type AS series, CAST(ts AS DATE) AS date, CAST(sum(floor(greatest(value - 60, 0))) AS BIGINT) AS count FROM events GROUP BY 1, 2)"


@query("counter_files_scan", f"WITH {COUNTERS} SELECT series, strftime(date, '%Y-%m-%d') AS stem, count FROM files")
def _(spark, sf):
    files = counters.counter_files(spark, write_counter_files(spark, sf), date_pattern=DAY_IN_PATH, series_pattern=TYPE_IN_PATH)
    return files.groupBy("series", "stem").agg(F.sum("count").alias("count"))


@query("primary_counter_days", f"WITH {COUNTERS} SELECT date, CAST(sum(count) AS BIGINT) AS count FROM files WHERE series = 'click' GROUP BY date HAVING sum(count) > 0")
def _(spark, sf):
    files = counters.counter_files(spark, write_counter_files(spark, sf) + "/kind=click", date_pattern=DAY_IN_PATH)
    return counters.counter_days(files, drop_zero=True)


@query("people_flow_days", f"WITH {COUNTERS} SELECT series, date, count FROM files")
def _(spark, sf):
    files = counters.counter_files(spark, write_counter_files(spark, sf), date_pattern=DAY_IN_PATH, series_pattern=TYPE_IN_PATH)
    return counters.counter_days(files, drop_zero=False, by_series=True)


def write_mixed_files(spark, sf) -> str:
    """The counter files next to files of another kind and files without any header word, one per region."""
    root = write_counter_files(spark, sf)
    table(spark, sf, "region").select(F.lit("silent").alias("kind"), F.col("r_regionkey").alias("day"), F.lit(None).cast("string").alias("x")
                                      ).repartition("kind", "day").write.mode("append").partitionBy("kind", "day").csv(root)
    return root


@query("counter_file_audit", """SELECT event_type AS kind, count(DISTINCT CAST(ts AS DATE)) AS n_files, CAST(0 AS BIGINT) AS n_unreadable, CAST(0 AS BIGINT) AS n_lacking FROM events GROUP BY 1
UNION ALL SELECT 'other', count(DISTINCT CAST(o_orderdate AS DATE)), 0, count(DISTINCT CAST(o_orderdate AS DATE)) FROM orders
UNION ALL SELECT 'silent', count(*), count(*), 0 FROM region""")
def _(spark, sf):
    files = file_audit(spark, write_mixed_files(spark, sf), ql.COUNTER_COLUMNS)
    return files.groupBy(F.regexp_extract("file", TYPE_IN_PATH, 1).alias("kind")).agg(
        F.count("*").alias("n_files"), F.count_if(~F.col("readable")).alias("n_unreadable"),
        F.count_if(F.col("readable") & (F.size("missing_columns") > 0)).alias("n_lacking"))


@query("counter_report_from_files", f"""WITH {COUNTERS}, d AS (SELECT date, sum(count) AS count FROM files GROUP BY date)
SELECT 'counter' AS source_name, count(*) AS n_rows, 'aggregate from, aggregate to, note, orders, total count' AS actual_columns,
'aggregate from, aggregate to, total count' AS missing_columns, 'note, orders' AS extra_columns,
concat_ws(' ', (SELECT count(*) FROM region) || ' unreadable files.', 'Missing columns: aggregate from, aggregate to, total count') AS errors, false AS passed FROM d""")
def _(spark, sf):
    root = write_mixed_files(spark, sf)
    days = counters.counter_days(counters.counter_files(spark, root, date_pattern=DAY_IN_PATH, series_pattern=TYPE_IN_PATH), drop_zero=False)
    report = ql.counter_report(durable(days), files=file_audit(spark, root, ql.COUNTER_COLUMNS))
    return report.select("source_name", "n_rows", *[F.array_join(c, ", ").alias(c) for c in ("actual_columns", "missing_columns", "extra_columns")],
                         F.array_join("errors", " ").alias("errors"), "passed")


def write_hours(spark, sf, stations=None) -> str:
    """Hourly files per station with old field names; the temperature of one station is sometimes unreadable."""
    root = scratch_path(spark, "hours")
    rows = hours(spark, sf)
    rows = rows.withColumn("temp_c", F.when((F.col("station") == "view") & (F.col("temp_c") > 60), "--").otherwise(F.col("temp_c").cast("string")))
    rows = rows.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    rows.write.option("header", True).partitionBy("station").csv(root)
    return root


WEATHER_FILES = f"""{HOURS}, w AS (SELECT station, CAST(timestamp AS DATE) AS date, sum(precip_1h_mm) AS precip, avg(CASE WHEN station = 'view' AND temp_c > 60 THEN NULL ELSE temp_c END) AS temp,
  avg(sun_1h_h) AS sun, avg(wind_speed_ms) AS wind, avg(snow_depth_cm) AS snow_depth, avg(humidity_pct) AS humidity FROM hours GROUP BY 1, 2)"""
WEATHER_DIGITS = r6("temp", "sun", "wind", "snow_depth", "humidity")


STATIONS = ("click", "error", "purchase", "signup", "view")


@query("weather_files_with_fallback", f"WITH {WEATHER_FILES} SELECT * EXCLUDE (station) FROM w WHERE station = 'view'", WEATHER_DIGITS)
def _(spark, sf):
    root = write_hours(spark, sf)
    return weather.read_weather_days(spark, root + "/station=absent", root + "/station=view")


@query("site_weather_files", f"WITH {WEATHER_FILES} SELECT station AS site, date, temp, precip, wind, snow_depth FROM w", r6("temp", "wind", "snow_depth"))
def _(spark, sf):
    root = write_hours(spark, sf)
    return weather.read_site_weather(spark, {s: f"{root}/station={s}" for s in (*STATIONS, "closed")})


def write_intent(spark, sf) -> str:
    """A folder per year whose first week repeats in the folder of the year before with other numbers; two headers."""
    root = scratch_path(spark, "intent")
    days = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias(INTENT), F.sum("o_custkey").alias("clicks"))
    days = days.withColumn("year", F.year("date"))
    overlap = days.where(F.dayofyear("date") <= 7).withColumns({"year": F.col("year") - 1, INTENT: F.col(INTENT) + 100})
    days = days.unionByName(overlap)
    days.where("year < 1998").select("year", "date", INTENT, "clicks").repartition("year").write.option("header", True).partitionBy("year").csv(root)
    days.where("year >= 1998").select("year", "clicks", F.col(INTENT), "date").repartition("year").write.mode("append").option("header", True).partitionBy("year").csv(root)
    return root


@query("yearly_intent_files", f"""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1)
SELECT date, CAST(CASE WHEN dayofyear(date) <= 7 THEN n + 100 ELSE n END AS DOUBLE) AS intent FROM d""")
def _(spark, sf):
    return intent.read_intent_days(spark, write_intent(spark, sf), ["route_searches", INTENT])


ANSWERS_A_FILE = 20_000


def write_survey(spark, sf) -> str:
    """Free-text answers as files with two headers; texts keep their line breaks and quotes."""
    root = scratch_path(spark, "survey")
    rows = texts(spark, sf).select(
        F.col("prefecture").alias("region"), F.when(F.col("location") == "src3", "no date").otherwise(F.col("date").cast("string")).alias("answered on"),
        F.col("satisfaction").cast("int").alias("overall rating"), F.concat(F.lit("would recommend "), F.regexp_extract("location", r"(\d+)", 1)).alias("recommend"),
        F.col("location").alias("place"), F.col("reason").alias("rating reason"), F.col("inconvenience").alias("inconvenience met"), F.col("doc_id"))
    # A file with line breaks in quotes is read by one task, so none may grow with the table.
    writer = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "maxRecordsPerFile": ANSWERS_A_FILE}
    rows.where("doc_id is not null and place < 'src15'").write.options(**writer).csv(root + "/a")
    other = rows.where("place >= 'src15'").select("region", "answered on", "place", F.lit("fine").alias("service reason"), "rating reason", "overall rating",
                                                 "doc_id", "inconvenience met")
    other.write.options(**writer).csv(root + "/b")
    return root


NAMES = {"satisfaction": "overall rating", "nps": "recommend", "location": "place", "reason": "rating reason", "inconvenience": "inconvenience met"}


@query("survey_region_dates", f"WITH {TEXTS} SELECT prefecture, date, count(*) AS n FROM texts WHERE location <> 'src3' GROUP BY 1, 2")
def _(spark, sf):
    return survey.survey_dates(spark, write_survey(spark, sf)).groupBy("prefecture", "date").agg(F.count("*").alias("n"))


@query("survey_satisfaction_files", f"""WITH {TEXTS} SELECT prefecture, date, satisfaction, CAST(NULL AS DOUBLE) AS satisfaction_service,
CASE WHEN location < 'src15' THEN TRY_CAST(regexp_extract(location, '(\\d+)', 1) AS DOUBLE) END AS nps_raw, location, reason, coalesce(inconvenience, '') AS inconvenience, '' AS freetext
FROM texts WHERE location <> 'src3'""")
def _(spark, sf):
    return survey.survey_satisfaction(spark, write_survey(spark, sf), NAMES)


@query("survey_text_files", f"WITH {TEXTS} SELECT prefecture, date, satisfaction, reason, coalesce(inconvenience, '') AS inconvenience, '' AS freetext FROM texts WHERE location <> 'src3'")
def _(spark, sf):
    return survey.survey_texts(spark, write_survey(spark, sf), satisfaction="overall", reason="reason", not_reason="service",
                               inconvenience="inconvenience", freetext="free")


@query("wide_survey_file", """SELECT 'north' AS prefecture, CAST(o_orderdate AS DATE) AS date, CAST(length(o_orderpriority) AS DOUBLE) AS satisfaction, CAST(count(*) AS BIGINT) AS n,
CAST(sum(length(o_orderstatus) + 17) AS BIGINT) AS letters FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2, 3""")
def _(spark, sf):
    # A hundred columns, the rating in the 90th; days by slashes without zeros, bad days, answers of three lines with quotes and commas.
    root = scratch_path(spark, "wide")
    orders = table(spark, sf, "orders")
    day = F.when(F.col("o_orderstatus") == "P", "31/12").otherwise(F.date_format("o_orderdate", "y/M/d"))
    rating = F.length("o_orderpriority").cast("string")
    answer = F.concat(F.lit('one, "two"\nthree\n'), "o_orderstatus")
    fill = [F.lit(str(i)).alias(f"other {i}") for i in range(96)]
    orders.select(F.lit("north").alias("region"), day.alias("answered on"), *fill[:87], rating.alias("overall rating"), answer.alias("rating reason"), *fill[87:]) \
        .write.options(header=True, escape='"').csv(root)
    rows = survey.survey_satisfaction(spark, root, {"satisfaction": "overall rating", "reason": "rating reason"})
    return rows.groupBy("prefecture", "date", "satisfaction").agg(F.count("*").alias("n"), F.sum(F.length("reason")).alias("letters"))


@query("raw_survey_file", """SELECT CAST(o_orderdate AS DATE) AS date, CAST(CASE o_orderstatus WHEN 'F' THEN 5000.0 WHEN 'O' THEN 20000.0 END AS DOUBLE) AS spending_midpoint, count(*) AS n FROM orders GROUP BY 1, 2""")
def _(spark, sf):
    root = scratch_path(spark, "raw")
    table(spark, sf, "orders").select(F.col("o_orderdate").cast("string").alias("answered"), F.col("o_orderstatus").alias("class")).write.option("header", True).csv(root)
    rows = survey.raw_survey(spark, root, date="answered", spending="class", midpoints={"F": 5000.0, "O": 20000.0})
    return rows.groupBy("date", "spending_midpoint").agg(F.count("*").alias("n"))


def write_station_exports(spark, sf) -> str:
    """Station exports in the Japanese code page: preamble, three header lines, doubled columns, one file a station and day."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    root = scratch_path(spark, "export")
    base = hours(spark, sf).withColumn("day", F.to_date("timestamp"))

    def whole(c: str):
        return F.col(c).cast("long").cast("string")

    data = base.select("station", "day", F.struct(F.lit(4).alias("k"), F.col("timestamp")).alias("ord"), F.array(
        F.date_format("timestamp", "y/M/d H:mm:ss"), whole("temp_c"), F.lit("8"), whole("precip_1h_mm"), F.lit("8"), F.lit(""), F.lit("8"), whole("snow_depth_cm"), F.lit("8"),
        whole("sun_1h_h"), F.lit("8"), whole("wind_speed_ms"), F.lit("8"), F.lit("北"), F.lit("8"), F.when(F.col("temp_c") > 30, "晴").otherwise(""), F.lit("8"),
        F.when(F.col("humidity_pct") > 40, whole("humidity_pct")).otherwise("×"), F.lit("8")).alias("c"))
    labels = [station.TIMESTAMP_LABEL, "気温(℃)", "気温(℃)", "降水量(mm)", "降水量(mm)", "降雪(cm)", "降雪(cm)", "積雪(cm)", "積雪(cm)", "日照時間(時間)", "日照時間(時間)",
              "風速(m/s)", "風速(m/s)", "風速(m/s)", "風速(m/s)", "天気", "天気", "相対湿度(％)", "相対湿度(％)"]
    sub = [""] * 13 + ["風向", "風向"] + [""] * 4
    quality = [""] + ["", "品質情報"] * 9
    lines = [["ダウンロードした時刻：2024/02/01"] + [""] * 18, labels, sub, quality]
    heads = base.select("station", "day").distinct().select("station", "day", F.posexplode(F.array(*[
        F.array(*[F.lit(x) for x in line]) for line in lines])).alias("k", "c"))
    heads = heads.select("station", "day", F.struct("k", F.lit(None).cast("timestamp_ntz").alias("timestamp")).alias("ord"), "c")
    rows = heads.unionByName(data).repartition("station", "day").sortWithinPartitions("station", "day", "ord")
    rows.select("station", "day", *[F.col("c")[i].alias(f"c{i}") for i in range(19)]).write.option("encoding", "CP932").option(
        "emptyValue", "").partitionBy("station", "day").csv(root)
    return root


@query("station_export_rows", f"""WITH {HOURS} SELECT timestamp, snow_depth_cm, CAST(NULL AS DOUBLE) AS snowfall_1h_cm, temp_c, precip_1h_mm, sun_1h_h, wind_speed_ms,
CASE WHEN temp_c > 30 THEN '晴' END AS weather_type, CASE WHEN humidity_pct > 40 THEN humidity_pct END AS humidity_pct FROM hours""")
def _(spark, sf):
    return station.read_station_exports(spark, write_station_exports(spark, sf)).drop("source_file")


@query("scraped_cells", f"""WITH {HOURS} SELECT station, CASE WHEN hour(timestamp) = 0 THEN timestamp ELSE timestamp END AS timestamp,
CASE WHEN temp_c > 60 THEN '' ELSE CAST(CAST(temp_c AS BIGINT) AS VARCHAR) END AS temp_c, CAST(CAST(precip_1h_mm AS BIGINT) AS VARCHAR) AS precip_1h_mm
FROM hours WHERE station <> 'error'""")
def _(spark, sf):
    rows = hours(spark, sf)
    header = [("時", "時"), ("気温", "気温"), ("降水量", "降水量")]
    names = ["hour", "temp_c", "precip_1h_mm"]
    clock = F.hour("timestamp")
    # As scraped: midnight is hour 24 of the day before, flags and markers stand in the cells, some rows have no hour.
    raw = rows.select(
        "station", F.to_date(F.col("timestamp") - F.expr("INTERVAL 1 HOUR")).alias("date"),
        F.when(F.col("station") == "error", "合計").otherwise(F.when(clock == 0, "24").otherwise(clock.cast("string"))).alias("c0"),
        F.when(F.col("temp_c") > 60, "///").otherwise(F.concat(F.col("temp_c").cast("long").cast("string"), F.lit(" )"))).alias("c1"),
        F.concat(F.lit(" "), F.col("precip_1h_mm").cast("long").cast("string"), F.lit("]")).alias("c2"))
    place = {n: f"c{locate_header(header, w)}" for n, w in zip(names, ["時", "気温", "降水量"], strict=True)}
    tidy = raw.withColumnsRenamed({c: n for n, c in place.items()})
    out = station.scraped_hours(tidy, cells={"station": "station", "temp_c": "temp_c", "precip_1h_mm": "precip_1h_mm"})
    return out


UPSERT = f"""{HOURS}, old AS (SELECT timestamp, CAST(sum(precip_1h_mm) AS DOUBLE) AS precip_1h_mm FROM hours WHERE station NOT IN ('error', 'purchase') GROUP BY 1),
fresh AS (SELECT timestamp, arg_max(precip_1h_mm, station) AS precip_1h_mm FROM hours WHERE station IN ('error', 'purchase') GROUP BY 1),
merged AS (SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE timestamp NOT IN (SELECT timestamp FROM fresh))"""


def upsert_sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = hours(spark, sf)
    old = rows.where(~F.col("station").isin("error", "purchase")).groupBy("timestamp").agg(F.sum("precip_1h_mm").alias("precip_1h_mm"))
    new = rows.where(F.col("station").isin("error", "purchase")).select("timestamp", "precip_1h_mm", F.col("station").alias("source_file"))
    return old.withColumn("source_file", F.lit("old")), new


@query("keyed_upsert", f"WITH {UPSERT} SELECT * FROM merged")
def _(spark, sf):
    old, new = upsert_sides(spark, sf)
    return sinks.upsert(old, new, ["timestamp"], ["source_file"]).drop("source_file")


@query("monthly_upsert_table", f"WITH {UPSERT} SELECT * FROM merged")
def _(spark, sf):
    old, new = upsert_sides(spark, sf)
    path = scratch_path(spark, "weather")
    sinks.upsert_months(spark, path, old, ["timestamp"], ["source_file"])
    sinks.upsert_months(spark, path, new, ["timestamp"], ["source_file"])
    return spark.read.parquet(path).select("timestamp", "precip_1h_mm")


@query("incremental_upsert", f"WITH {UPSERT} SELECT * FROM merged")
def _(spark, sf):
    # The old rows are taken in first; then files with the new ones arrive and only those are read.
    old, new = upsert_sides(spark, sf)
    root, path, seen = scratch_path(spark, "arrivals"), scratch_path(spark, "weather"), scratch_path(spark, "seen")
    for name, side in (("1", old), ("2", new)):
        text = side.select(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "precip_1h_mm", F.col("source_file").alias("origin"))
        text.write.option("header", True).csv(f"{root}/{name}")
        stream = incremental.new_rows(spark, root, "timestamp timestamp_ntz, precip_1h_mm double, origin string")
        incremental.start_upsert(stream, path, ["timestamp"], ["origin"], checkpoint=seen).awaitTermination()
    return spark.read.parquet(path).select("timestamp", "precip_1h_mm")


@query("fixed_order_csv", f"WITH {HOURS} SELECT strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp, CAST(CAST(temp_c AS BIGINT) AS VARCHAR) AS temp_c, CAST(NULL AS VARCHAR) AS weather_type, CAST(1 AS INT) AS month FROM hours")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    rows = hours(spark, sf).withColumn("temp_c", F.col("temp_c").cast("long"))
    sinks.write_monthly_csv(rows.withColumn("timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz")), path, station.STATION_COLUMNS)
    back = spark.read.option("header", True).csv(path)
    return back.select(F.substring("timestamp", 1, 19).alias("timestamp"), "temp_c", "weather_type", "month")


@query("station_days", f"WITH {WEATHER_FILES} SELECT station, date, precip FROM w")
def _(spark, sf):
    rows = weather.typed_hours(hours(spark, sf), series="station")
    return dl.daily_measures(rows, series="station", sums={"precip": "precip"})


@query("header_lines", """SELECT 'order' AS kind, count(*) AS n FROM orders""")
def _(spark, sf):
    # Every file of a folder is read by position; lines equal to the header of their file are left out.
    root = scratch_path(spark, "lines")
    table(spark, sf, "orders").select(F.lit("order").alias("kind"), "o_orderkey").write.option("header", True).csv(root)
    cells = read_cells(spark, root, width=4)
    return cells.where(F.col("cells")[0] != "kind").groupBy(F.col("cells")[0].alias("kind")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- audits from paths

STATION_IN_PATH = r"station=([^/]+)/"
HOURLY = ("timestamp", *sorted(ql.WEATHER_COLUMNS))


def write_silent(spark, sf, root: str) -> None:
    """A file a region in which no cell holds a word."""
    table(spark, sf, "region").select(F.lit(None).cast("string").alias("x"), F.col("r_regionkey").alias("part")).repartition("part").write.partitionBy("part").csv(root)


def write_station_files(spark, sf) -> str:
    """Hourly files of the sites as stations, one of them without snow depth, next to a station whose files are silent."""
    root = scratch_path(spark, "stations")
    rows = readings(spark, sf).withColumn("timestamp", F.date_format("date", "yyyy-MM-dd HH:mm:ss"))
    for site, columns in (("A", HOURLY), ("N", [c for c in HOURLY if c != "snow_depth_cm"]), ("R", HOURLY[::-1])):
        rows.where(F.col("site") == site).select(*columns).write.option("header", True).csv(f"{root}/station={site}")
    write_silent(spark, sf, f"{root}/station=mute")
    return root


def write_survey_with_silent(spark, sf) -> str:
    root = write_survey(spark, sf)
    write_silent(spark, sf, root + "/c")
    return root


# Lines per station: the numbers of a report and its notes; events are tests of drift with p below the level.
STATION_LINES = f"""{READINGS}, long AS (SELECT site, date, 'temp_c' AS name, temp_c AS value FROM readings
  UNION ALL SELECT site, date, 'precip_1h_mm', precip_1h_mm FROM readings UNION ALL SELECT site, date, 'wind_speed_ms', wind_speed_ms FROM readings),
{DRIFT_STEPS}, {DRIFT_TESTS}, drifts AS (SELECT site, count(*) AS checks, count(*) FILTER (WHERE p < 0.05) AS events FROM p GROUP BY site),
span AS (SELECT site, count(*) AS n, min(date) AS first_date, max(date) AS last_date, date_diff('day', min(date), max(date)) + 1 - count(DISTINCT date) AS gaps,
  min(temp_c) AS cold, max(temp_c) AS hot, max(wind_speed_ms) AS wind, min(precip_1h_mm) AS rain FROM readings GROUP BY site),
stations AS (SELECT site AS station, n AS n_rows, CASE site WHEN 'N' THEN 6 ELSE 7 END AS n_columns, first_date, last_date, gaps AS n_gaps,
  CASE site WHEN 'N' THEN 5 ELSE 6 END AS n_checks, coalesce(checks, 0) AS n_drift_checks, coalesce(events, 0) AS n_drift_events,
  list_filter([CASE WHEN gaps > 0 THEN gaps || ' date gaps detected.' END, CASE WHEN site = 'N' THEN 'Missing columns: snow_depth_cm' END,
    CASE WHEN cold < -40 THEN 'Suspicious minimum temperature.' END, CASE WHEN hot > 50 THEN 'Suspicious maximum temperature.' END,
    CASE WHEN wind > 60 THEN 'Extreme wind speed.' END], lambda x: x IS NOT NULL) AS w,
  list_filter([CASE WHEN rain < 0 THEN 'Negative precipitation detected.' END], lambda x: x IS NOT NULL) AS e
  FROM span LEFT JOIN drifts USING (site)
  UNION ALL SELECT 'closed', 0, 0, NULL, NULL, 0, 0, 0, 0, [], ['No weather row could be read.', 'No file found.']
  UNION ALL SELECT 'mute', 0, 0, NULL, NULL, 0, 0, 0, 0, [], ['No weather row could be read.', (SELECT count(*) FROM region) || ' unreadable files.'])"""


@query("weather_report_from_files", f"""WITH {STATION_LINES} SELECT 'weather ' || station AS source_name, * EXCLUDE (station, w, e),
  array_to_string(w, ' ') AS warnings, array_to_string(e, ' ') AS errors, len(e) = 0 AS passed FROM stations""")
def _(spark, sf):
    report = audits.weather_files_report(spark, write_station_files(spark, sf), station_pattern=STATION_IN_PATH, stations=("A", "closed"), law="series")
    return report.select(
        "source_name", "n_rows", "n_columns", "first_date", "last_date", "n_gaps", F.size("column_checks").alias("n_checks"),
        F.size("drift_checks").alias("n_drift_checks"), ql.drift_events().alias("n_drift_events"),
        F.array_join("warnings", " ").alias("warnings"), F.array_join("errors", " ").alias("errors"), "passed")


SURVEY_PARTS = ("overall", "recommend", "income")
SURVEY_LINE = """survey AS (SELECT count(*) AS n_rows, count(DISTINCT prefecture) AS n_regions, count(*) FILTER (WHERE satisfaction NOT BETWEEN 1 AND 5) AS n_out_of_range,
  avg(satisfaction) AS mean, list_filter(['Missing columns: income', CASE WHEN count(*) FILTER (WHERE satisfaction NOT BETWEEN 1 AND 5) > 0 THEN 'Satisfaction values outside 1..5.' END,
    (SELECT count(*) FROM region) || ' unreadable files.'], lambda x: x IS NOT NULL) AS w FROM texts WHERE location IS NOT NULL)"""


@query("survey_report_from_files", f"""WITH {TEXTS}, {SURVEY_LINE} SELECT 'survey' AS source_name, n_rows, 9 AS n_columns, n_out_of_range, n_regions, 'income' AS missing_columns,
mean, array_to_string(w, ' ') AS warnings, '' AS errors, true AS passed FROM survey""", r6("mean"))
def _(spark, sf):
    report = audits.survey_files_report(spark, write_survey_with_silent(spark, sf), satisfaction="overall", expected=SURVEY_PARTS)
    return report.select(
        "source_name", "n_rows", "n_columns", "n_out_of_range", "n_regions", F.array_join("missing_columns", ", ").alias("missing_columns"),
        F.col("column_checks")[0]["mean"].alias("mean"), F.array_join("warnings", " ").alias("warnings"), F.array_join("errors", " ").alias("errors"), "passed")


@query("audit_totals_from_files", f"""WITH {STATION_LINES}, {TEXTS}, {SURVEY_LINE}, {COUNTERS}, d AS (SELECT date, sum(count) AS count FROM files GROUP BY date),
lines AS (SELECT n_rows, len(w) AS warnings, len(e) AS errors, n_drift_events AS events FROM stations
  UNION ALL SELECT n_rows, len(w), 0, 0 FROM survey
  UNION ALL SELECT count(*), CAST(date_diff('day', min(date), max(date)) + 1 > count(*) AS INT) + CAST(count(*) FILTER (WHERE count = 0) > 0 AS INT), 2, 0 FROM d
  UNION ALL SELECT 0, 0, 2, 0)
SELECT count(*) AS total_sources_audited, CAST(sum(n_rows) AS BIGINT) AS total_rows_audited, CAST(sum(warnings) AS BIGINT) AS total_warnings,
CAST(sum(errors) AS BIGINT) AS total_errors, CAST(sum(events) AS BIGINT) AS total_drift_events, sum(errors) = 0 AS overall_passed FROM lines""")
def _(spark, sf):
    root, stations, answers = at_once([partial(write, spark, sf) for write in (write_mixed_files, write_station_files, write_survey_with_silent)])
    reports = audits.audit_files(spark, {
        "counter": ("counter", {"path": root, "date_pattern": DAY_IN_PATH, "series_pattern": None, "law": "series"}),
        "old counter": ("counter", {"path": root + "/kind=absent"}),
        "weather": ("weather", {"path": stations, "station_pattern": STATION_IN_PATH, "stations": ("closed",), "law": "series"}),
        "survey": ("survey", {"path": answers, "satisfaction": "overall", "expected": SURVEY_PARTS})})
    return ql.audit_totals(list(reports.values()))
