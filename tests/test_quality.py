import gzip

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from daygauge.functions.distributions import two_sample_ks_p
from daygauge.operators import order_stats as od
from daygauge.operators import quality as ql
from daygauge.sources.columns import file_audit
from daygauge.sources.counters import counter_days, counter_files


def test_schema_diff():
    assert ql.schema_diff(["a", "b", "c"], ["a", "b", "c"]) == ([], [])
    assert ql.schema_diff(["a", "c", "d"], ["a", "b", "c"]) == (["b"], ["d"])


def test_profile_basics(frame):
    pdf = pd.DataFrame({"v": [1.0, np.nan, 3.0, np.nan, 5.0], "w": [np.nan] * 5})
    rows = {r["name"]: r for r in ql.column_profile(frame(pdf, "v double, w double"), ["v", "w"]).collect()}
    assert rows["v"].pct_missing == 40.0 and rows["v"]["mean"] == 3.0 and rows["v"].q25 == 2.0
    assert rows["w"]["mean"] is None and rows["w"].n_missing == 5 and rows["w"].n_outliers_iqr == 0


def test_profile_against_pandas_with_a_hot_series(frame):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"site": ["hot"] * 3000 + ["a"] * 40 + ["b"] * 2, "v": np.concatenate([rng.normal(50, 5, 2998), [200, 210], rng.normal(0, 1, 42)])})
    got = ql.column_profile(frame(pdf), ["v"], series="site").toPandas().set_index("site")
    for site, part in pdf.groupby("site"):
        v = part.v
        q1, q3 = v.quantile([0.25, 0.75])
        reach = 1.5 * (q3 - q1)
        assert got.loc[site, "q25"] == pytest.approx(q1) and got.loc[site, "q75"] == pytest.approx(q3)
        assert got.loc[site, "std"] == pytest.approx(v.std())
        assert got.loc[site, "n_outliers_iqr"] == ((v < q1 - reach) | (v > q3 + reach)).sum()
        assert got.loc[site, "n_outliers_zscore"] == (((v - v.mean()).abs() / v.std()) > 3.5).sum()
    assert got.loc["hot", "n_outliers_zscore"] >= 2


def test_quantiles_are_exact(frame):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "value": rng.integers(0, 40, 500).astype(float)})
    got = od.exact_quantiles(frame(pdf), ["g"], "value", (0, 0.1, 0.5, 0.9, 1), list("abcde")).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert np.allclose(got.loc[g, list("abcde")].astype(float), part.value.quantile([0, 0.1, 0.5, 0.9, 1]))


def test_missed_bracket_orders_everything(frame):
    pdf = pd.DataFrame({"g": ["a"] * 101 + ["b"] * 7, "value": [*np.arange(101.0), *np.arange(7.0)]})
    df = frame(pdf)
    wrong = df.groupBy("g").agg(F.count("value").alias("_n"), F.array(F.lit(90.0)).alias("_lo"), F.array(F.lit(95.0)).alias("_hi"))
    got = {r.g: r.q for r in od.quantiles_within(df, wrong, ["g"], "value", [0.5], ["q"]).collect()}
    assert got == {"a": 50.0, "b": 3.0}


def test_large_tables_are_not_broadcast(spark):
    small, large = spark.range(10), spark.range(30)
    plans = [spark.range(100).join(od.checked_small(t, limit=20), "id")._jdf.queryExecution().optimizedPlan().toString() for t in (small, large)]
    assert "broadcast" in plans[0] and "broadcast" not in plans[1]


def test_global_numbering(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    got = od.numbered(rows, ["v"]).collect()
    assert all(r.v == r.position for r in got) and len(got) == 1000


def blocks(pdf):
    months = sorted(pdf.date.dt.to_period("M").unique())
    for i in range(0, len(months) - 3, 3):
        a = pdf[pdf.date.dt.to_period("M").isin(months[i:i + 3])].value.to_numpy()
        b = pdf[pdf.date.dt.to_period("M").isin(months[i + 3:i + 6])].value.to_numpy()
        if len(a) >= 10 and len(b) >= 10:
            grid = np.unique(np.concatenate([a, b]))
            d = np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b)).max()
            yield d, two_sample_ks_p(d, len(a), len(b)), a, b


def test_drift_against_brute_force(frame):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=365), "value": np.round(rng.normal(50, 5, 365))})
    got = ql.drift(frame(pdf), ["value"]).orderBy("period_a").collect()
    want = list(blocks(pdf))
    assert len(got) == len(want) == 4 - 1
    for row, (d, p, a, b) in zip(got, want, strict=True):
        assert row.ks_statistic == pytest.approx(d, abs=5.1e-5) and row.ks_pvalue == pytest.approx(p, abs=5.1e-5)
        assert row.mean_a == pytest.approx(a.mean()) and row.std_b == pytest.approx(b.std())
    assert sum(r.drift_detected for r in got) <= 2


def test_obvious_drift_and_short_input(frame):
    rng = np.random.default_rng(1)
    value = np.where(np.arange(300) < 130, 7.0, 11.0) + rng.normal(0, 1, 300)
    pdf = pd.DataFrame({"date": pd.date_range("2023-03-01", periods=300), "value": value})
    assert ql.drift(frame(pdf), ["value"]).where("drift_detected").count() >= 1
    assert ql.drift(frame(pdf[:25]), ["value"]).count() == 0


def test_weather_report_flags(frame):
    n = 40
    pdf = pd.DataFrame({"timestamp": pd.date_range("2024-01-01", periods=n, freq="D").astype(str), "temp_c": [60.0] + [10.0] * (n - 1),
                        "precip_1h_mm": [-1.0] + [0.0] * (n - 1), "wind_speed_ms": 3.0})
    df = frame(pdf).withColumn("timestamp", F.to_timestamp("timestamp"))
    row = ql.weather_report(df.where("dayofmonth(timestamp) <> 5")).first()
    assert not row.passed and row.errors == ["Negative precipitation detected."]
    assert "Suspicious maximum temperature." in row.warnings and row.n_gaps == 2
    assert row.missing_columns == ["humidity_pct", "snow_depth_cm", "sun_1h_h"]
    totals = ql.audit_totals([ql.weather_report(df)]).first()
    assert totals.total_errors == 1 and not totals.overall_passed


def test_counter_report(frame):
    pdf = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=40), "count": [0] + [5] * 39})
    row = ql.counter_report(frame(pdf), ["aggregate from", "total count"]).first()
    assert not row.passed and row.errors == ["Missing columns: aggregate to"]
    assert row.warnings == ["Zero-count days (possible counter outage)."]


def test_reports_over_paths(spark, tmp_path):
    root = tmp_path / "counter"
    root.mkdir()
    (root / "a.csv").write_text("aggregate from,aggregate to,total count\n2024-01-01 00:00,2024-01-01 01:00,4\n")
    (root / "b.csv").write_text("total count,aggregate from\n7,2024-01-02 00:00\n")
    (root / "c.csv").write_text("")
    files = file_audit(spark, str(root), ql.COUNTER_COLUMNS)
    assert {r.file[-5:]: (r.readable, r.missing_columns) for r in files.collect()} == {
        "a.csv": (True, []), "b.csv": (True, ["aggregate to"]), "c.csv": (False, None)}
    days = counter_days(counter_files(spark, str(root), date_pattern=r"(\d{4}-\d{2}-\d{2})"), drop_zero=False)
    row = ql.counter_report(days, files=files).first()
    assert not row.passed and row.errors[-2:] == ["1 unreadable files.", "Missing columns: aggregate to"]
    assert row.actual_columns == ["aggregate from", "aggregate to", "total count"] and row.n_columns == 3


def test_report_without_any_file(spark, frame, tmp_path):
    pdf = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=2), "count": [1, 2]})
    row = ql.counter_report(frame(pdf).limit(0), files=file_audit(spark, str(tmp_path / "none"), ql.COUNTER_COLUMNS)).first()
    assert not row.passed and row.n_rows == 0 and row.actual_columns == []
    assert row.errors == ["No counter day could be read.", "No file found."]
    answers = frame(pd.DataFrame({"sat": [3.0, 9.0], "where": ["n", "s"]}))
    report = ql.survey_report(answers, satisfaction="sat", region="where", expected=["sat"], files=file_audit(spark, str(tmp_path / "none")))
    assert report.first().errors == ["No file found."] and report.first().warnings == ["Satisfaction values outside 1..5."]


def test_station_without_rows_and_drift_totals(frame):
    rng = np.random.default_rng(23)
    temp = np.where(np.arange(330) < 160, 4.0, 19.0) + rng.normal(0, 1, 330)
    pdf = pd.DataFrame({"station": "north", "timestamp": pd.date_range("2023-02-01", periods=330).astype(str), "temp_c": temp,
                        "precip_1h_mm": 0.0, "wind_speed_ms": 2.0})
    df = frame(pdf).withColumn("timestamp", F.to_timestamp("timestamp"))
    report = ql.weather_report(df, series="station", stations=["north", "south"])
    rows = {r.source_name: r for r in report.collect()}
    south = rows["weather south"]
    assert south.n_rows == 0 and south.errors == ["No weather row could be read."] and south.column_checks == []
    drifted = sum(d.drift_detected for d in rows["weather north"].drift_checks)
    totals = ql.audit_totals([report]).first()
    assert drifted >= 1 and totals.total_drift_events == drifted and totals.total_sources_audited == 2 and totals.total_errors == 1


def test_audits_of_paths_by_station(spark, tmp_path):
    """A whole, a narrow, a headerless and an absent station, and a file that ends within its stream."""
    from daygauge.sources import audits

    days = "".join(f"2024-01-0{d} 00:00:00,{d}.5,-1\n" for d in (1, 2, 4))
    for name, text in {"whole": "timestamp,temp_c,precip_1h_mm\n" + days, "narrow": "temp_c,timestamp\n7,2024-01-01 00:00:00\n", "mute": ",\n"}.items():
        (tmp_path / f"station={name}").mkdir()
        (tmp_path / f"station={name}" / "hours.csv").write_text(text)
    cut = tmp_path / "station=cut"
    cut.mkdir()
    packed = gzip.compress(("timestamp,temp_c\n" + "".join(f"2024-01-01 {i % 24:02}:00:00,{i * 7919 % 50}\n" for i in range(40_000))).encode())
    (cut / "hours.csv.gz").write_bytes(packed[:-20])
    got = {r.source_name: r for r in audits.weather_files_report(spark, str(tmp_path), station_pattern=r"station=([^/]+)/", stations=["whole", "gone"]).collect()}
    assert set(got) == {f"weather {s}" for s in ("whole", "narrow", "mute", "cut", "gone")}
    whole, narrow = got["weather whole"], got["weather narrow"]
    assert whole.errors == ["Negative precipitation detected."] and whole.n_gaps == 1 and whole.n_columns == 3
    assert {c.name for c in whole.column_checks} == {"temp_c", "precip_1h_mm"} and narrow.passed
    assert [c.name for c in narrow.column_checks] == ["temp_c"] and "precip_1h_mm" in narrow.missing_columns
    assert got["weather mute"].errors == ["No weather row could be read.", "1 unreadable files."] and got["weather mute"].missing_columns == []
    assert any(e.startswith("1 damaged files") for e in got["weather cut"].errors)
    assert got["weather gone"].errors == ["No weather row could be read.", "No file found."] and got["weather gone"].n_columns == 0


def test_audits_of_absent_folders(spark, tmp_path):
    from daygauge.sources import audits

    gone = str(tmp_path / "gone")
    reports = audits.audit_files(spark, {
        "gates": ("counter", {"path": gone}), "sky": ("weather", {"path": gone}),
        "visitors": ("survey", {"path": gone, "satisfaction": "rating", "expected": ["rating"]})})
    for name, report in reports.items():
        row = report.first()
        assert row.source_name == name and not row.passed and row.n_rows == 0 and "No file found." in row.errors
    total = ql.audit_totals(list(reports.values())).first()
    assert total.total_sources_audited == 3 and total.total_errors == 6 and not total.overall_passed


def test_survey_file_that_cannot_be_read_is_a_warning(spark, tmp_path):
    from daygauge.sources import audits

    (tmp_path / "a.csv").write_text("where,rating overall,why\nnorth,4,\"one\ntwo\"\nsouth,9,x\n")
    (tmp_path / "b.csv").write_text("where,other,rating overall\n,z,3\n")
    (tmp_path / "c.csv").write_text(",\n")
    row = audits.survey_files_report(spark, str(tmp_path), satisfaction="rating", expected=["rating", "nps"]).first()
    assert row.passed and row.n_rows == 3 and row.n_columns == 4 and row.n_out_of_range == 1 and row.region_missing == 1
    assert row.warnings == ["Missing columns: nps", "Satisfaction values outside 1..5.", "1 unreadable files."]
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "c.csv").write_text(",\n")
    row = audits.survey_files_report(spark, str(tmp_path / "only"), satisfaction="rating", expected=["rating"]).first()
    assert row.errors == ["No survey row could be read.", "1 unreadable files."] and row.missing_columns == []
