"""Data audit: schema, column profiles, gaps, drift, and reports per source."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygauge.functions.distributions import ks_law_used, ks_p
from daygauge.functions.scalars import finite_or_null, has_text, number
from daygauge.operators.daily import attach, coverage, keys, missing_days
from daygauge.operators.order_stats import (checked_small, quantile_brackets, quantiles_from, quantiles_within, running_totals,
                                            unpivot, value_counts)

COUNTER_COLUMNS = ("aggregate from", "aggregate to", "total count")
WEATHER_COLUMNS = ("temp_c", "precip_1h_mm", "sun_1h_h", "wind_speed_ms", "humidity_pct", "snow_depth_cm")


def schema_diff(columns: Sequence[str], expected: Sequence[str]) -> tuple[list[str], list[str]]:
    """(missing, extra) column names, sorted."""
    have, want = set(columns), set(expected)
    return sorted(want - have), sorted(have - want)


def value_table(df: DataFrame, columns: Sequence[str], *, series=None, date: str | None = None) -> DataFrame:
    """(series, name, value, n) of raw numeric columns, split by month if dated: the one ordered pass over the rows that
    profiles and drift tests share. It is written, since several steps read it."""
    by = [*keys(series), "name"]
    if date is None:
        return value_counts(unpivot(df, columns, keys(series)), by)
    dated = df.withColumn("_month", F.trunc(F.to_date(date), "month"))
    return value_counts(unpivot(dated, columns, [*keys(series), "_month"]), by, extra=["_month"])


def column_profile(df: DataFrame, columns: Sequence[str], *, series=None, z: float = 3.5, k: float = 1.5,
                   values: DataFrame | None = None) -> DataFrame:
    """Profile of raw numeric columns, one row per series and column.

    Three passes with partial aggregation: moments and quartile brackets, exact quartiles, outlier counts. Given a
    ``value_table``, the last two read that instead of the rows, and the first reads each row once for all columns.
    """
    by = [*keys(series), "name"]
    dtypes = dict(df.dtypes)

    def moments(value: Column) -> dict[str, Column]:
        return {"n_total": F.count("*"), "n_missing": F.count_if(value.isNull()), "mean": F.avg(value), "std": F.stddev_samp(value),
                "min": F.min(value), "max": F.max(value)}

    probs, names = (0.25, 0.75), ("q25", "q75")
    if values is None:
        long = unpivot(df, columns, keys(series))
        counts = long.where("value is not null").withColumn("n", F.lit(1).cast("long"))
        brackets = quantile_brackets(long, by, "value", probs, extra=[m.alias(k) for k, m in moments(F.col("value")).items()])
        basics = brackets.drop("_n", "_lo", "_hi")
        quartiles = quantiles_within(long, brackets.where("_n > 0"), by, "value", probs, names)
    else:
        counts = values.where(F.col("name").isin(*columns)).groupBy(*by, "_part", "value").agg(F.sum("n").alias("n"))
        # All columns side by side, so that no row is taken apart; without a row there is no group.
        wide = df.groupBy(*keys(series)).agg(*[m.alias(f"_{i}_{k}") for i, c in enumerate(columns) for k, m in moments(number(c)).items()])
        basics = wide.select(*keys(series), F.inline(F.array(*[
            F.struct(F.lit(c).alias("name"), *[F.col(f"_{i}_{k}").alias(k) for k in moments(number(c))])
            for i, c in enumerate(columns)]))).where("n_total > 0")
        quartiles = quantiles_from(running_totals(counts, by, "value", ["n"]), by, probs, names)
    stats = checked_small(basics.join(quartiles, by, "left"))
    reach = k * (F.col("q75") - F.col("q25"))
    outside = (F.col("value") < F.col("q25") - reach) | (F.col("value") > F.col("q75") + reach)
    far = F.abs(F.col("value") - F.col("mean")) / F.when(F.col("std") > 0, F.col("std")) > z
    outliers = counts.join(stats, by).groupBy(*by).agg(
        F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("n_outliers_iqr"),
        F.sum(F.when(far, F.col("n")).otherwise(0)).alias("n_outliers_zscore"))
    kind = F.create_map(*[F.lit(v) for c in columns for v in (c, dtypes[c])])
    pct = F.bround(F.col("n_missing") / F.greatest(F.col("n_total"), F.lit(1)) * 100, 2)
    return stats.join(outliers, by, "left").select(
        *by, kind[F.col("name")].alias("dtype"), "n_total", "n_missing", pct.alias("pct_missing"),
        *[finite_or_null(c).alias(c) for c in ("mean", "std", "min", "max", "q25", "q75")],
        F.coalesce("n_outliers_iqr", F.lit(0)).cast("long").alias("n_outliers_iqr"),
        F.coalesce("n_outliers_zscore", F.lit(0)).cast("long").alias("n_outliers_zscore"))


def date_gaps(rows: DataFrame, *, date: str = "date", series=None) -> DataFrame:
    return missing_days(rows, date=date, series=series)


def month_blocks(rows: DataFrame, *, date: str = "date", series=None, months: int = 3) -> DataFrame:
    """Months present in a series with the number of their block of ``months`` consecutive present months."""
    by = keys(series)
    present = rows.select(*by, F.to_date(F.date_trunc("month", date)).alias("_month")).where("_month is not null").distinct()
    w = Window.partitionBy(*by).orderBy("_month")
    return present.withColumn("_block", F.floor((F.row_number().over(w) - 1) / months).cast("int"))


def drift(rows: DataFrame, columns: Sequence[str], *, date: str = "date", series=None, blocks_of: int = 3,
          min_block: int = 10, min_rows: int = 30, level: float = 0.05, values: DataFrame | None = None, law: str = "auto") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test of each block of months against the next, per series and column.

    ``law`` is that of ``two_sample_ks_p``; ``ks_law`` tells which one a row's p-value has.

    The rows are read once into a ``value_table`` placed by value range. Blocks, moments and both empirical
    distributions are sums over that table, so no block is ever gathered in one task.
    """
    by = [*keys(series), "name"]
    placed = value_table(rows, columns, series=series, date=date) if values is None else values.where(F.col("name").isin(*columns))
    placed = placed.where("_month is not null")
    months = placed.groupBy(*by, "_month").agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("value")).alias("_s"))
    whole, in_order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_month")
    # Squares are summed around the overall mean, which keeps them small next to the spread.
    blocks = months.select(
        *by, "_month", (F.sum("_s").over(whole) / F.sum("_n").over(whole)).alias("_c"), F.sum("_n").over(whole).alias("_rows"),
        F.floor((F.row_number().over(in_order) - 1) / blocks_of).cast("int").alias("_block")).where(F.col("_rows") >= min_rows)

    blocks = checked_small(blocks)
    sides = placed.join(blocks, [*by, "_month"]).select(*by, "_part", "value", "_c", F.inline(F.array(
        F.struct(F.col("_block").alias("_pair"), F.col("n").alias("n_a"), F.lit(0).cast("long").alias("n_b")),
        F.struct((F.col("_block") - 1).alias("_pair"), F.lit(0).cast("long").alias("n_a"), F.col("n").alias("n_b")))))
    merged = sides.groupBy(*by, "_pair", "_part", "value", "_c").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    totals = running_totals(merged, [*by, "_pair"], "value", ["n_a", "n_b"], carry=["_c"])

    def share(s: str) -> Column:
        total = F.col(f"n_{s}_total")
        return (F.col(f"n_{s}_before") + F.col(f"n_{s}")) / F.when(total > 0, total)

    off = F.col("value") - F.col("_c")
    sums = [c for s in "ab" for c in (
        F.max(f"n_{s}_total").alias(f"rows_{s}"), (F.sum(F.col(f"n_{s}") * F.col("value")) / F.sum(f"n_{s}")).alias(f"mean_{s}"),
        (F.sum(F.col(f"n_{s}") * off) / F.sum(f"n_{s}")).alias(f"_m{s}"),
        (F.sum(F.col(f"n_{s}") * off * off) / F.sum(f"n_{s}")).alias(f"_q{s}"))]
    tests = totals.where((F.col("n_a_total") >= min_block) & (F.col("n_b_total") >= min_block)).groupBy(*by, "_pair").agg(
        F.max(F.abs(share("a") - share("b"))).alias("d"), *sums)
    spans = blocks.groupBy(*by, "_block").agg(F.concat_ws(
        "/", F.date_format(F.min("_month"), "yyyy-MM"), F.date_format(F.max("_month"), "yyyy-MM")).alias("_span"))
    name_a = spans.select(*by, F.col("_block").alias("_pair"), F.col("_span").alias("period_a"))
    name_b = spans.select(*by, (F.col("_block") - 1).alias("_pair"), F.col("_span").alias("period_b"))
    out = tests.join(name_a, [*by, "_pair"]).join(name_b, [*by, "_pair"])
    out = out.withColumn("_p", ks_p(F.col("d"), F.col("rows_a"), F.col("rows_b"), law))
    return out.select(
        *by, "period_a", "period_b", "rows_a", "rows_b", "mean_a", "mean_b",
        *[F.sqrt(F.greatest(F.col(f"_q{s}") - F.col(f"_m{s}") * F.col(f"_m{s}"), F.lit(0.0))).alias(f"std_{s}") for s in "ab"],
        F.bround("d", 4).alias("ks_statistic"), F.bround("_p", 4).alias("ks_pvalue"), (F.col("_p") < level).alias("drift_detected"),
        ks_law_used(F.col("rows_a"), F.col("rows_b"), law).alias("ks_law"))


# ---------------------------------------------------------------- source reports

def _note(condition: Column, text: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), text)


def _notes(*notes: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.filter(F.array(*notes), lambda x: x.isNotNull()) if notes else empty


def _as_list(rows: DataFrame, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """A result table (one row per column or per block pair) as one sorted array of structs per source."""
    first = [*order, *[c for c in rows.columns if c not in order and c not in by]]
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*first))).alias(out))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def file_totals(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row over a ``file_audit``, or one per group: files, unreadable files, all column names, those that some readable file lacks."""
    def union(column: Column | str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_set(column))))

    return files.groupBy(*by).agg(F.count("*").alias("_files"), F.count_if(~F.col("readable")).alias("_unreadable"),
                     F.count("damage").alias("_damaged"), F.coalesce(F.sum("n_lost"), F.lit(0)).alias("_lost"),
                     union("columns").alias("_actual"),
                     union(F.when(F.col("readable"), F.col("missing_columns"))).alias("_lacking"))


def with_files(out: DataFrame, files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each source with its ``file_totals``; a source without a file has none of them."""
    have = attach(out, file_totals(files, by), by).fillna(0, ["_files", "_unreadable", "_damaged", "_lost"])
    return have.withColumns({c: F.coalesce(c, _strings([])) for c in ("_actual", "_lacking")})


def file_notes() -> list[Column]:
    """Errors that ``file_totals`` give rise to."""
    return [_note(F.col("_files") == 0, F.lit("No file found.")),
            _note(F.col("_unreadable") > 0, F.concat(F.col("_unreadable").cast("string"), F.lit(" unreadable files."))),
            _note(F.col("_damaged") > 0, F.concat(F.col("_damaged").cast("string"), F.lit(" damaged files, "), F.col("_lost").cast("string"),
                                                  F.lit(" records known to be lost.")))]


def source_report(name: str, rows: DataFrame, *, expected: Sequence[str], actual: Sequence[str], profile: Sequence[str],
                  drift_columns: Sequence[str], date: str, series=None, extra_warnings: Sequence[tuple[Column, str]] = (),
                  extra_errors: Sequence[tuple[Column, str]] = (), counts: Sequence[Column] = (),
                  missing_is_error: bool = False, files: DataFrame | None = None, sources: Sequence[str] | None = None,
                  shown: int = 30, law: str = "auto") -> DataFrame:
    """One nested row per source: coverage, schema, gaps, column checks, drift checks, warnings, errors, passed.

    With ``series`` all stations of one kind are audited by the same jobs and give a row each, named
    "name series"; each of ``sources`` gets a row, also if it has no rows. ``counts`` are named aggregates over the rows
    that the extra notes may refer to. With ``files`` (a ``file_audit``) the columns are those of the files and not
    ``actual``, a column counts as missing if any readable file lacks it, and files without a header are errors. Files that
    carry the ``series`` are judged per source, each of their sources gets a row too, and expected columns that no file of a source
    has are not profiled for it. ``actual_columns`` holds the first ``shown`` names; ``law`` is that of ``drift``.
    """
    by = keys(series)
    own = list(by) if files is not None and all(c in files.columns for c in by) else []
    out = rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.min(F.to_date(date)).alias("first_date"),
                                F.max(F.to_date(date)).alias("last_date"), *counts)
    known = [] if sources is None else [rows.sparkSession.createDataFrame([(s,) for s in sources], f"{by[0]} string")]
    known += [files.select(*own)] if own else []
    if known:
        every = reduce(DataFrame.unionByName, known).distinct()
        out = every.join(out, by, "full").fillna(0, ["n_rows"])
    gaps = missing_days(rows, date=date, series=series).groupBy(*by).agg(F.count("*").alias("n_gaps"))
    profiled = [c for c in profile if c in rows.columns]
    values = value_table(rows, profiled, series=series, date=date)
    checks = _as_list(column_profile(rows, profiled, series=series, values=values), by, ["name"], "column_checks")
    drifts = _as_list(drift(rows, [c for c in drift_columns if c in profiled], date=date, series=series, values=values, law=law), by,
                      ["name", "period_a"], "drift_checks")
    for part in (gaps, checks, drifts):
        out = attach(out, part, by)
    out = with_files(out, files, own) if files is not None else out.withColumn("_actual", _strings(actual))
    want = _strings(sorted(set(expected)))
    lacking = F.col("_lacking") if files is not None else F.array_except(want, "_actual")
    absent = _strings([])
    if files is not None:
        absent = F.array_except(want, "_actual")
    out = out.withColumns({"n_gaps": F.coalesce("n_gaps", F.lit(0)).cast("long"),
                           "column_checks": F.filter(F.coalesce("column_checks", F.array().cast(checks.schema["column_checks"].dataType)),
                                                     lambda check: ~F.array_contains(absent, check["name"])),
                           "drift_checks": F.coalesce("drift_checks", F.array().cast(drifts.schema["drift_checks"].dataType)),
                           "missing_columns": F.array_sort(lacking), "extra_columns": F.array_sort(F.array_except("_actual", want)),
                           "expected_columns": _strings(expected), "actual_columns": F.slice("_actual", 1, shown)})
    lost = _note(F.size("missing_columns") > 0, F.concat(F.lit("Missing columns: "), F.array_join("missing_columns", ", ")))
    warnings = [_note(F.col("n_gaps") > 0, F.concat(F.col("n_gaps").cast("string"), F.lit(" date gaps detected.")))]
    errors = [_note(cond, F.lit(text)) for cond, text in extra_errors] + (file_notes() if files is not None else [])
    (errors if missing_is_error else warnings).append(lost)
    warnings += [_note(cond, F.lit(text)) for cond, text in extra_warnings]
    out = out.withColumns({"warnings": _notes(*warnings), "errors": _notes(*errors)})
    title = F.concat_ws(" ", F.lit(name), *[F.col(c).cast("string") for c in by])
    return out.select(
        title.alias("source_name"), "n_rows", F.size("_actual").alias("n_columns"), "first_date", "last_date", "n_gaps",
        "expected_columns", "actual_columns", "missing_columns", "extra_columns", "column_checks", "drift_checks",
        "warnings", "errors", (F.size("errors") == 0).alias("passed"))


def counter_report(days: DataFrame, columns: Sequence[str] = (), *, name: str = "counter", date: str = "date",
                   count: str = "count", files: DataFrame | None = None, series=None, law: str = "auto") -> DataFrame:
    """Audit of day totals read from counter files whose header was ``columns``, or from the ``files`` of a
    ``file_audit``; no day at all is an error. With ``series`` each counter has a report."""
    return source_report(
        name, days, expected=COUNTER_COLUMNS, actual=columns, profile=[count], files=files, series=series, law=law,
        drift_columns=[count], date=date, missing_is_error=True, counts=[F.count_if(F.col(count) == 0).alias("n_zero")],
        extra_warnings=[(F.col("n_zero") > 0, "Zero-count days (possible counter outage).")],
        extra_errors=[(F.col("n_rows") == 0, "No counter day could be read.")])


def weather_report(hours: DataFrame, *, name: str = "weather", date: str = "timestamp", series=None,
                   stations: Sequence[str] | None = None, files: DataFrame | None = None, law: str = "auto") -> DataFrame:
    """Audit of hourly weather; negative precipitation is an error, implausible values are warnings.

    Each of ``stations`` gets a report; for one without rows that no row could be read is an error.
    """
    fields = [c for c in hours.columns if c not in keys(series)]
    have = set(fields)

    def extreme(fn, column: str, out: str) -> Column:
        return (fn(number(column)) if column in have else F.lit(None).cast("double")).alias(out)

    return source_report(
        name, hours, expected=("timestamp", *sorted(WEATHER_COLUMNS)), actual=fields, series=series, profile=WEATHER_COLUMNS,
        sources=stations, files=files, law=law, drift_columns=("temp_c", "precip_1h_mm", "wind_speed_ms"), date=date,
        counts=[extreme(F.min, "temp_c", "t_lo"), extreme(F.max, "temp_c", "t_hi"), extreme(F.min, "precip_1h_mm", "p_lo"),
                extreme(F.max, "wind_speed_ms", "w_hi")],
        extra_warnings=[(F.col("t_lo") < -40, "Suspicious minimum temperature."), (F.col("t_hi") > 50, "Suspicious maximum temperature."),
                        (F.col("w_hi") > 60, "Extreme wind speed.")],
        extra_errors=[(F.col("n_rows") == 0, "No weather row could be read."), (F.col("p_lo") < 0, "Negative precipitation detected.")])


def survey_report(answers: DataFrame, *, satisfaction: str, region: str, expected: Sequence[str], name: str = "survey",
                  files: DataFrame | None = None) -> DataFrame:
    """Audit of survey answers: expected names are matched as parts of column names.

    With ``files`` (a ``file_audit``) the columns are those of the files; files without a header are warnings, no file, none that
    can be read and damaged files are errors.
    """
    rating = number(satisfaction)
    rows = answers.select(rating.alias("satisfaction"), F.col(region).cast("string").alias("_region"))
    head = rows.agg(F.count("*").alias("n_rows"), F.count_if(~F.col("satisfaction").between(1, 5)).alias("n_out_of_range"),
                    F.count_if(F.col("_region").isNull()).alias("region_missing"), F.count_distinct("_region").alias("n_regions"))
    checks = _as_list(column_profile(rows, ["satisfaction"]), [], ["name"], "column_checks")
    out = attach(head, checks, [])
    out = out.withColumn("_actual", _strings(answers.columns)) if files is None else with_files(out, files)
    lost = F.filter(_strings(expected), lambda e: ~F.exists("_actual", lambda c: F.contains(c, e)))
    if files is not None:  # without a header there is nothing to judge
        lost = F.when(F.size("_actual") > 0, lost).otherwise(_strings([]))
    out = out.withColumns({"source_name": F.lit(name), "missing_columns": lost})
    absent, unreadable, damaged = file_notes() if files is not None else (F.lit(None).cast("string"),) * 3
    some = F.lit(False) if files is None else F.col("_unreadable") < F.col("_files")
    out = out.withColumns({
        "warnings": _notes(_note(F.size("missing_columns") > 0, F.concat(F.lit("Missing columns: "), F.array_join("missing_columns", ", "))),
                           _note(F.col("n_out_of_range") > 0, F.lit("Satisfaction values outside 1..5.")), F.when(some, unreadable)),
        "errors": _notes(_note(F.col("n_rows") == 0, F.lit("No survey row could be read.")), absent, F.when(~some, unreadable), damaged)})
    pct = F.bround(F.col("region_missing") / F.greatest(F.col("n_rows"), F.lit(1)) * 100, 2)
    return out.select("source_name", "n_rows", F.size("_actual").alias("n_columns"), "n_out_of_range", "n_regions",
                      "region_missing", pct.alias("region_pct_missing"), "missing_columns", "column_checks", "warnings",
                      "errors", (F.size("errors") == 0).alias("passed"))


def drift_events() -> Column:
    """Tests of a report that found drift."""
    return F.size(F.filter("drift_checks", lambda d: d["drift_detected"]))


def audit_totals(reports: Sequence[DataFrame]) -> DataFrame:
    """Sources, rows, warnings, errors, drift events and overall verdict over all source reports."""
    lines = [r.select("source_name", "n_rows", F.size("warnings").alias("w"), F.size("errors").alias("e"),
                      (drift_events() if "drift_checks" in r.columns else F.lit(0)).alias("d"), "passed") for r in reports]
    return reduce(DataFrame.unionByName, lines).agg(
        F.count("*").alias("total_sources_audited"), F.sum("n_rows").alias("total_rows_audited"),
        F.sum("w").alias("total_warnings"), F.sum("e").alias("total_errors"), F.sum("d").alias("total_drift_events"),
        F.bool_and("passed").alias("overall_passed"))


def source_coverage(sources: dict[str, DataFrame], *, date: str = "date") -> DataFrame:
    return reduce(DataFrame.unionByName, [
        coverage(df, date=date).withColumn("source_name", F.lit(name)) for name, df in sources.items()])


def range_violations(df: DataFrame, limits: dict[str, tuple[float | None, float | None]], *, series=None) -> DataFrame:
    """Per column the number of values below its lower or above its upper limit."""
    aggs = []
    for c, (lo, hi) in limits.items():
        v = number(c)
        below = v < lo if lo is not None else F.lit(False)
        above = v > hi if hi is not None else F.lit(False)
        aggs.append(F.count_if(below | above).alias(c))
    wide = df.groupBy(*keys(series)).agg(*aggs)
    return wide.select(*keys(series), F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("n_violations")) for c in limits])))


def region_profile(df: DataFrame, region: str) -> DataFrame:
    total, missing = F.count("*"), F.count_if(F.col(region).isNull())
    return df.agg(total.alias("n_total"), missing.alias("n_missing"),
                  F.bround(missing / F.greatest(total, F.lit(1)) * 100, 2).alias("pct_missing"),
                  F.count_distinct(region).alias("n_distinct"))


def rows_mentioning(df: DataFrame, column: str, part: str) -> DataFrame:
    return df.where(has_text(column, part))
