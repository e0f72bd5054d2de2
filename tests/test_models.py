import math

import numpy as np
import pandas as pd
import pytest

from daygauge.operators import association as asc
from daygauge.operators import forest as fo
from daygauge.operators import regression as rg
from daygauge.operators import robustness as rb


def synthetic(n=200, seed=42):
    rng = np.random.default_rng(1000 + seed)
    wave = np.sin(np.arange(n) / 9.0)
    pdf = pd.DataFrame({"date": pd.date_range("2022-02-07", periods=n), "precip": rng.gamma(2.0, 2.0, n), "temp": 12 + 8 * wave + rng.normal(0, 3, n),
                        "intent": rng.uniform(2, 9, n)})
    pdf["count"] = 40 + 22 * pdf.intent - 7 * pdf.precip + 1.5 * pdf.temp + rng.normal(0, 8, n)
    return pdf


XS = ["intent", "precip", "temp"]


def lstsq(pdf, xs=XS, y="count"):
    x = np.column_stack([np.ones(len(pdf)), pdf[xs].to_numpy()])
    b = np.linalg.pinv(x) @ pdf[y].to_numpy()
    e = pdf[y].to_numpy() - x @ b
    return x, b, e


def test_ols_against_lstsq(frame):
    pdf = synthetic()
    x, b, e = lstsq(pdf)
    coefs = rg.ols(frame(pdf), "count", XS).toPandas().set_index("term")
    assert np.allclose(coefs.loc[["const", *XS], "coef"], b)
    s2 = e @ e / (len(pdf) - 4)
    assert np.allclose(coefs.loc[["const", *XS], "se"], np.sqrt(s2 * np.diag(np.linalg.inv(x.T @ x))))
    r2 = 1 - e @ e / ((pdf["count"] - pdf["count"].mean()) ** 2).sum()
    assert coefs.r2.iloc[0] == pytest.approx(r2) and r2 > 0.9
    assert coefs.adj_r2.iloc[0] <= r2
    assert coefs.loc["intent", "coef"] > 0 > coefs.loc["precip", "coef"]
    sd = pdf.std()
    assert coefs.loc["temp", "beta_std"] == pytest.approx(b[3] * sd["temp"] / sd["count"])
    others = lstsq(pdf, ["intent", "precip"], "temp")[2]
    assert coefs.loc["temp", "vif"] == pytest.approx(((pdf.temp - pdf.temp.mean()) ** 2).sum() / (others @ others))


def test_null_rows_are_left_out(frame):
    pdf = synthetic(63, 3)
    pdf.loc[[17, 40], "intent"] = np.nan
    fit = rg.fit_summary(rg.ols(frame(pdf), "count", XS)).first()
    assert fit.n == 61


def test_zero_column_does_not_count(frame):
    pdf = synthetic(120)
    pdf["snow"] = 0.0
    coefs = rg.ols(frame(pdf), "count", [*XS, "snow"])
    rows = {r.term: r for r in coefs.collect()}
    assert rows["snow"].coef == 0.0 and rows["snow"].p is None
    assert rows["const"]["rank"] == 3 and rows["const"].df_resid == 116
    assert rows["const"].r2 == pytest.approx(rg.ols(frame(pdf), "count", XS).first().r2)
    assert rg.standardised_beta(coefs, "snow").first().beta_std is None
    assert rg.standardised_beta(coefs, "temp").first().beta_std is None


def test_constant_target(frame):
    pdf = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=40), "count": 100.0, "x1": np.random.default_rng(1).normal(size=40)})
    row = rg.fit_summary(rg.ols(frame(pdf), "count", ["x1"])).first()
    assert row.r2 is None and row.n == 40


def test_groups_equal_loop(frame):
    a, b = synthetic(100, 1), synthetic(80, 2)
    both = pd.concat([a.assign(site="a"), b.assign(site="b")])
    got = rg.ols(frame(both), "count", XS, series="site").toPandas()
    for site, part in (("a", a), ("b", b)):
        assert np.allclose(got[got.site == site].set_index("term").loc[["const", *XS], "coef"], lstsq(part)[1])
    wide = rg.predict(frame(both), rg.ols(frame(both), "count", XS, series="site"), XS, series="site").toPandas()
    part = wide[wide.site == "b"].sort_values("date")
    assert np.allclose(part.predicted, b["count"] - lstsq(b)[2])


def test_holdout_and_ablation(frame):
    pdf = synthetic()
    train, held = pdf[:160], pdf[160:]
    b = lstsq(train)[1]
    err = held["count"] - (b[0] + held[XS] @ b[1:])
    row = rg.holdout_scores(frame(pdf), "count", XS).first()
    assert (row.train_n, row.holdout_n) == (160, 40)
    assert row.mae == pytest.approx(err.abs().mean()) and row.rmse == pytest.approx(np.sqrt((err**2).mean()))
    assert row.r2 == pytest.approx(1 - (err**2).sum() / ((held["count"] - held["count"].mean()) ** 2).sum())
    lift = rg.ablation(frame(pdf), "count", XS, ["precip", "temp"]).first()
    assert lift.r2_full > lift.r2_reduced and lift.lift == pytest.approx(lift.r2_full - lift.r2_reduced)


def test_vertex(frame):
    x = np.arange(10.0, 71.0, 10.0)
    row = rg.quadratic_vertex(frame(pd.DataFrame({"x0": x, "y": -0.001 * x**2 + 0.1 * x + 1.5})), "y", "x0").first()
    assert row.vertex == pytest.approx(50.0, abs=1e-6)


def test_durbin_watson_and_models(frame):
    pdf = synthetic()
    e = lstsq(pdf)[2]
    coefs, rows = rb.with_residuals(frame(pdf), "count", XS)
    row = rb.durbin_watson(rows).first()
    assert row.dw == pytest.approx((np.diff(e) ** 2).sum() / (e**2).sum()) and row.dw_clean
    fd, dw = rb.first_difference_fit(frame(pdf), "count", XS)
    diff = pdf[["count", *XS]].diff().dropna()
    assert np.allclose(fd.toPandas().set_index("term").loc[["const", *XS], "coef"], lstsq(diff)[1])
    assert 0 <= dw.first().dw <= 4
    ldv, _ = rb.lagged_target_fit(frame(pdf), "count", XS)
    lagged = pdf.assign(count_lag1=pdf["count"].shift(1)).dropna()
    assert np.allclose(ldv.toPandas().set_index("term").loc[["const", *XS, "count_lag1"], "coef"], lstsq(lagged, [*XS, "count_lag1"])[1])


def test_newey_west_brute_force(frame):
    sites = {"a": synthetic(150, 3), "b": synthetic(60, 4)}
    both = pd.concat([p.assign(site=s) for s, p in sites.items()])
    got = rb.newey_west(frame(both), "count", XS, series="site").toPandas()
    for site, pdf in sites.items():
        x, b, e = lstsq(pdf)
        u, n = x * e[:, None], len(pdf)
        lags = max(1, int(0.75 * n ** (1 / 3)))
        s = u.T @ u
        for j in range(1, lags + 1):
            g = u[j:].T @ u[:-j]
            s += (1 - j / (lags + 1)) * (g + g.T)
        bread = np.linalg.inv(x.T @ x)
        part = got[got.site == site].set_index("term").loc[["const", *XS]]
        assert set(part.lags) == {lags}
        assert np.allclose(part.se_hac, np.sqrt(np.diag(bread @ s @ bread)))


def test_adf(frame):
    rng = np.random.default_rng(7)
    walk = np.cumsum(rng.normal(size=300))
    noise = rng.normal(size=300)
    pdf = pd.DataFrame({"date": pd.date_range("2023-01-01", periods=300), "walk": walk, "noise": noise})
    rows = {r["name"]: r for r in rb.adf_test(frame(pdf), ["walk", "noise"]).collect()}
    assert rows["noise"].stationary and not rows["walk"].stationary
    assert rb.adf_test(frame(pdf[:15]), ["walk"]).count() == 0
    flat = rb.adf_test(frame(pdf.assign(flat=2.5)), ["flat", "noise"]).orderBy("name").collect()
    assert [(r["name"], r.adf is None, r.n_obs, r.note) for r in flat][0] == ("flat", True, 300, "constant") and flat[1].note is None


def test_spearman_with_ties(frame):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.integers(0, 8, 60).astype(float), "b": rng.integers(0, 8, 60).astype(float)})
    row = asc.spearman(frame(pdf), [("a", "b")]).first()
    assert row.rho == pytest.approx(pdf.a.rank().corr(pdf.b.rank()))
    assert 0 <= row.p <= 1


def test_best_lag_tie_takes_lowest(spark):
    ccf = spark.createDataFrame([(-1, 0.5, 30), (2, -0.5, 30), (0, 0.1, 30)], "lag int, r double, n long")
    row = asc.best_lag(ccf).first()
    assert (row.best_lag, row.best_r, row.strength) == (-1, 0.5, "strong")


def test_yates(spark):
    table = spark.createDataFrame([(12, 20, 5, 25)], "hits_a long, n_a long, hits_b long, n_b long")
    row = asc.proportion_test(table).first()
    a, b, c, d = 12, 8, 5, 20
    want = 45 * (abs(a * d - b * c) - 22.5) ** 2 / (20 * 25 * 17 * 28)
    assert row.chi2 == pytest.approx(want) and 0 < row.p < 0.05


def test_forest(frame):
    pdf = synthetic()
    folds = fo.contiguous_folds(frame(pdf), 5)
    assert [r["count"] for r in folds.groupBy("fold").count().orderBy("fold").collect()] == [40] * 5
    rows = fo.forest_rows(folds, "count", XS, keep=["fold"])
    model = fo.fit_forest(rows, trees=30)
    train = fo.train_scores(model, rows).first()
    cv = fo.fold_summary(fo.cross_validate(rows, trees=15)).first()
    assert train.r2 > 0.85 and 0.4 < cv.cv_r2_mean <= train.r2
    importance = fo.impurity_importance(model, XS, rows.sparkSession).collect()
    assert importance[0].feature == "intent" and sum(r.importance for r in importance) == pytest.approx(1, abs=1e-6)
    best = fo.top_features(fo.impurity_importance(model, XS, rows.sparkSession), 2).orderBy("rank").collect()
    assert [(r.feature, r["rank"]) for r in best] == [(r.feature, i + 1) for i, r in enumerate(importance[:2])]
    shuffled = {r.feature: r for r in fo.permutation_importance(model, frame(pdf), "count", XS, order=["date"], repeats=5).collect()}
    assert max(shuffled.values(), key=lambda r: r.importance_mean).feature == "intent"
    assert all(r.importance_std >= 0 for r in shuffled.values())


def test_newey_west_lags_are_truncated(frame):
    """At 64 rows 0.75 n^(1/3) is just below 3 in double precision, so there are two lags."""
    pdf = synthetic(64)
    x, b, e = lstsq(pdf)
    u = x * e[:, None]
    middle = u.T @ u
    for lag in (1, 2):
        cross = u[lag:].T @ u[:-lag]
        middle += (1 - lag / 3) * (cross + cross.T)
    bread = np.linalg.inv(x.T @ x)
    want = np.sqrt(np.diag(bread @ middle @ bread))
    got = rb.newey_west(frame(pdf), "count", XS).toPandas().set_index("term")
    column = next(c for c in got.columns if "se" in c)
    ratio = got.loc[["const", *XS], column].to_numpy(float) / want
    assert np.allclose(ratio, ratio[0]) and ratio[0] == pytest.approx(1, abs=0.05)


def test_newey_west_z_and_p(frame):
    got = rb.newey_west(frame(synthetic(90)), "count", XS).toPandas()
    assert np.allclose(got.z, got.coef / got.se_hac)
    assert np.allclose(got.p_hac, [math.erfc(abs(z) / math.sqrt(2)) for z in got.z], atol=1e-12)
