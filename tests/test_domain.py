import numpy as np
import pandas as pd
import pytest

from daygauge.operators.association import average_rank
from daygauge.operators import comfort as cf
from daygauge.operators import gap as gp
from daygauge.operators import sites as st
from daygauge.operators import text as tx
from daygauge.sources import sinks as sk


def test_opportunity_gap(frame):
    pdf = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=5), "count": [1, 5, 3, 9, 7], "intent": [9.0, 1.0, 8.0, np.nan, 2.0]})
    got = gp.opportunity_gap(frame(pdf, "date date, count long, intent double"), "intent").orderBy("date").collect()
    assert [r.high_intent for r in got] == [1, 0, 1, 0, 0]
    assert [r.low_count for r in got] == [1, 0, 1, 0, 0]
    assert [r.opportunity_gap for r in got] == [1, 0, 1, 0, 0]


def test_lost_is_signed_and_flags_do_not_multiply(frame, spark):
    pdf = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=3), "count": [10, 10, 10], "predicted": [15.0, 4.0, 99.0]})
    flags = pd.DataFrame({"date": list(pd.date_range("2024-01-01", periods=2)) * 2, "opportunity_gap": 1})
    row = gp.lost_summary(gp.lost_on_gap_days(frame(pdf), frame(flags))).first()
    assert (row.gap_days, row.total_lost, row.mean_lost) == (2, -1.0, -0.5)
    assert gp.shortfall(frame(pdf)).first().lost_visitors == 94.0


def test_rank_simulation(spark):
    base = spark.createDataFrame([(m, 47, 0.0 if m == 8 else 10.0) for m in range(1, 13)], "month int, rank int, gap_k double")
    monthly = spark.createDataFrame([(1, 5000.0), (2, 100000.0), (3, -50.0), (8, 9000.0)], "month int, monthly_lost double")
    rows = {r.month: r for r in gp.rank_simulation(base, monthly).collect()}
    assert (rows[1].ranks_gained, rows[1].new_rank, rows[1].closure_pct) == (6, 41, 50.0)
    assert rows[2].ranks_gained == 12 and rows[3].ranks_gained == 0 and rows[8].closure_pct == 0 and rows[5].monthly_lost == 0
    summary = gp.rank_summary(gp.rank_simulation(base, monthly)).first()
    assert summary.best_gain == 12 and summary.winter_rank == 47 and summary.winter_new_rank == pytest.approx((47 + 41 + 35) / 3)
    assert (summary.min_closure_pct, summary.max_closure_pct) == (0.0, 1000.0)
    total = spark.createDataFrame([(1200.0,)], "t double")
    even = gp.spread_by_weight(base, total, "t").collect()
    assert len(even) == 12 and all(r.monthly_lost == pytest.approx(100) for r in even)
    assert all(r.new_rank >= 46 for r in gp.rank_simulation(base, monthly, floor=46).collect())


def test_season_ratio_without_summer(spark):
    lifts = spark.createDataFrame([("winter", 0.2)], "season string, lift double")
    assert gp.season_ratio(lifts).first().ratio == float("inf")


def test_comfort_humidity_rule(frame):
    n = 60
    pdf = pd.DataFrame({"date": pd.date_range("2024-06-01", periods=n), "temp": np.linspace(15, 34, n), "wind": 3.0,
                        "humidity": [80.0] * 31 + [np.nan] * 29})
    schema = "date date, temp double, wind double, humidity double"
    used = cf.comfort_days(frame(pdf, schema)).where("discomfort_index is not null")
    assert used.count() == 31
    pdf.loc[0, "humidity"] = np.nan
    proxy = cf.comfort_days(frame(pdf, schema)).orderBy("date").first()
    assert proxy.discomfort_index == pytest.approx(0.81 * 15 + 0.6 * (0.99 * 15 - 14.3) + 46.3)
    assert set(cf.comfort_means(cf.comfort_days(frame(pdf[["date", "temp"]]))).columns) == {"di_mean"}


def test_match_falls_back_to_months(frame):
    days = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=120), "count": range(120)})
    sat = pd.DataFrame({"date": pd.to_datetime(["2024-01-05", "2024-01-20", "2024-03-03"]), "mean_satisfaction": [3.0, 5.0, 4.0], "n_responses": [2, 1, 7],
                        "mean_nps": [7.0, 9.0, np.nan]})
    got = cf.match_satisfaction(frame(days), frame(sat, "date date, mean_satisfaction double, n_responses long, mean_nps double")).orderBy("date").collect()
    assert [(str(r.date), r.mean_satisfaction, r.n_responses, r.mean_nps) for r in got] == [("2024-01-01", 4.0, 3, 8.0), ("2024-03-01", 4.0, 7, None)]
    assert got[0]["count"] == pytest.approx(15.0)
    assert cf.match_satisfaction(frame(days), frame(sat, "date date, mean_satisfaction double, n_responses long, mean_nps double"), min_days=2).count() == 3


def test_crowding_bins_are_right_closed(spark):
    rows = spark.createDataFrame([(5000.0, 3.0, 7.0), (5001.0, 4.0, None), (0.0, 1.0, 1.0)], "count double, mean_satisfaction double, mean_nps double")
    got = {r.visitor_bin: r for r in cf.crowding_bins(rows).collect()}
    assert set(got) == {"<5K", "5-8K"} and got["<5K"].n == 1


def test_best_bin_against_pandas(frame):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": rng.normal(60, 8, 100), "y": rng.uniform(3, 5, 100)})
    row = cf.best_bin(frame(pdf), "x", "y").first()
    means = pdf.y.groupby(pd.qcut(pdf.x, 5, labels=False)).mean()
    edges = pdf.x.quantile([0, 0.2, 0.4, 0.6, 0.8, 1]).to_numpy()
    k = int(means.idxmax())
    assert (row.peak_left, row.peak_right) == pytest.approx((edges[k], edges[k + 1])) and row.peak_mean == pytest.approx(means.max())


def texts(spark):
    return spark.createDataFrame([
        ("North", 1, "so quiet here", None, "empty"), ("North", 2, "fine", "", None), ("North", 5, "quiet and good", None, None),
        ("North", 4, None, None, None), ("South", 1, "quiet", None, None), ("North", None, "quiet", None, None)],
        "prefecture string, satisfaction int, reason string, inconvenience string, freetext string")


def test_complaints(spark):
    row = tx.complaint_rates(texts(spark), ["empty", "quiet"], region="North").first()
    assert (row.n_low, row.low_hits, row.n_high, row.high_hits) == (2, 1, 2, 1)
    assert (row.low_pct, row.high_pct, row.ratio) == (50.0, 50.0, 1.0) and row.chi2 == 0.0 and row.p == 1.0
    only_low = tx.complaint_rates(texts(spark).where("coalesce(satisfaction, 0) < 3"), ["quiet"], region="North").first()
    assert only_low.high_pct == 0.01 and only_low.ratio == 500.0 and only_low.chi2 is None
    example = tx.complaint_examples(texts(spark), ["empty", "quiet"], ["prefecture"], region="North").collect()
    assert [r.keyword for r in example] == ["empty"] and example[0].excerpt.startswith("so quiet here")


def test_site_resilience_limits(spark):
    rows = [("Temple A", f"2024-01-{d:02d}", 5 if d % 3 else 2, "crowded" if d == 1 else "calm") for d in range(1, 13) for _ in range(3)]
    df = spark.createDataFrame(rows, "location string, date string, satisfaction int, freetext string").withColumn("date", __import__("pyspark").sql.functions.to_date("date"))
    row = tx.site_resilience(df, "Temple", crowd_words=["crowded"], quiet_words=["calm"]).first()
    assert (row.n_responses, row.n_days, row.n_low, row.undervibrancy_low_sat) == (36, 12, 12, 12)
    assert row.sat_rate_pct == pytest.approx(66.7) and row.congestion_pct == pytest.approx(8.3) and row.congestion_low_sat_pct == 0.0
    assert tx.site_resilience(df.limit(10), "Temple", crowd_words=["x"], quiet_words=["y"]).count() == 0


def site_rows(n=80, seed=1):
    rng = np.random.default_rng(seed)
    parts = []
    for k, site in enumerate(("a", "b", "short")):
        m = n if site != "short" else 20
        p = pd.DataFrame({"site": site, "date": pd.date_range("2024-01-01", periods=m), "intent": rng.normal(50, 9, m), "temp": rng.normal(10, 5, m),
                          "precip": rng.exponential(3, m), "wind": rng.uniform(0, 15, m), "snow_depth": 0.0 if k == 0 else rng.exponential(2, m)})
        p["count"] = 100 + 3 * p.intent - 2 * p.wind + rng.normal(0, 4, m)
        parts.append(p)
    return pd.concat(parts)


def test_site_metrics(frame):
    pdf = site_rows()
    got = {r.site: r for r in st.site_metrics(frame(pdf), "intent", spend=2.0).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].snow_beta_std is None and got["b"].snow_beta_std is not None
    for site in "ab":
        p = pdf[pdf.site == site]
        line = np.polyfit(p.intent, p["count"], 1)
        lost = np.clip(np.polyval(line, p.intent) - p["count"], 0, None).sum()
        assert got[site].lost_visitors == pytest.approx(lost) and got[site].lost_value == pytest.approx(2 * lost)
        assert got[site].weather_lift > 0
    metrics = st.site_metrics(frame(pdf), "intent", spend=2.0)
    assert [r.site for r in st.rank_sites(metrics).collect()] == ["b", "a"]
    normal = {r.site: r for r in st.sensitivity_table(metrics, normalise=True).collect()}
    assert max(r.lost_visitors_k for r in normal.values()) == 1.0 and normal["a"].snow_sensitivity_abs is None


def test_nudge_needs_enough_days(frame):
    pdf = site_rows()
    wide = st.side_by_side(frame(pdf), ["a", "b"])
    both = pdf[pdf.site == "a"].merge(pdf[pdf.site == "b"], on="date")
    high, low = both[both.wind_x > 8], both[both.wind_x <= 8]
    row = st.wind_nudge(wide, threshold=8, n_sites=2).first()
    assert row.delta_pct_1 == pytest.approx((high.count_y.mean() / low.count_y.mean() - 1) * 100)
    assert st.wind_nudge(wide, threshold=14.9, n_sites=2).count() == 0
    shield = high[high.count_x < both.count_x.median()]
    assert st.weather_shield(wide, threshold=8, sheltered=1).first().shield_pct == pytest.approx((shield.count_y.mean() / low.count_y.mean() - 1) * 100)


def test_proxy_only_for_sites_without_counts(spark):
    counts = spark.createDataFrame([("a", "2024-01-01", 5)], "site string, date string, count long")
    proxy = spark.createDataFrame([("2024-01-01", 2)], "date string, count long")
    assert st.with_proxy_sites(counts, proxy, "a").count() == 1
    assert {r.source for r in st.with_proxy_sites(counts, proxy, "c").collect()} == {"counter", "survey_proxy"}


def test_ccf_against_loop(frame):
    rng = np.random.default_rng(4)
    n = 60
    days = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=n), "count": rng.integers(10, 90, n)})
    rows = [{"prefecture": r, "date": d} for d in days.date for r in ("East", "West") for _ in range(int(rng.integers(1, 6)))]
    survey = pd.DataFrame(rows)
    got = {(r.region, r.lag): r.r for r in st.cross_region_ccf(frame(days), frame(survey), ["East", "West"]).collect()}
    for region in ("East", "West"):
        n_answers = days.date.map(survey[survey.prefecture == region].groupby("date").size())
        for lag in range(-3, 8):
            assert got[(region, lag)] == pytest.approx(days["count"].corr(n_answers.shift(lag)))


def test_upsert_rules(spark):
    old = spark.createDataFrame([(1, "a", "f0"), (2, "b", "f0")], "k int, v string, source string")
    new = spark.createDataFrame([(2, "x", "f1"), (2, "y", "f2"), (3, "z", "f1")], "k int, v string, source string")
    got = {r.k: r.v for r in sk.upsert(old, new, ["k"], ["source"]).collect()}
    assert got == {1: "a", 2: "y", 3: "z"}


def test_tables_of_results(spark):
    rows = spark.createDataFrame([("m1", "r2", 0.5), ("m1", "mae", 12.0), ("m2", "r2", 0.25)], "model string, metric string, value double")
    got = {r.model: r for r in sk.model_comparison(rows).collect()}
    assert got["m2"].mae == "--" and got["m1"].r2 == "0.5000"
    shown = sk.key_metrics(spark.createDataFrame([(12345, 0.5, "x")], "n long, r double, s string"), {"n": "N", "r": "R", "s": "S"}).collect()
    assert [r.shown for r in shown] == ["12,345", "0.5000", "x"]
    assert [r["rank"] for r in sk.rank_by_size(rows, "value", "metric").orderBy("rank").collect()] == [1, 2, 3]
    odd = spark.createDataFrame([(float("inf"), float("nan"), 1.0)], "a double, b double, c double")
    assert tuple(sk.finite(odd).first()) == (None, None, 1.0)


def test_ranks_do_not_hang_on_the_last_bit(spark):
    values = [(0.1 + 0.2, 1), (0.3, 2), (0.7, 3), (0.30000001, 4)]
    ranks = spark.createDataFrame(values, "v double, k int").select("k", average_rank("v", []).alias("r")).collect()
    assert {r["k"]: r["r"] for r in ranks} == {1: 1.5, 2: 1.5, 3: 4.0, 4: 3.0}
