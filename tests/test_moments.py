import numpy as np
import pandas as pd
import pytest

from daygauge.operators import moments as mm


def test_blocks_merge_to_the_whole():
    rng = np.random.default_rng(2)
    x = rng.normal(1e6, 3, (500, 5))
    x[:, 2] = 0.1
    holes = np.where(rng.random(x.shape) < 0.2, np.nan, x)
    holes[:100, 4] = np.nan  # a block without any value of a column
    for pairwise, data in ((False, x), (True, holes)):
        whole = mm.block_moments(data, pairwise)
        parts = [mm.block_moments(data[a:b], pairwise) for a, b in ((0, 100), (100, 101), (101, 400), (400, 500))]
        total = parts[0]
        for part in parts[1:]:
            total = mm.merged(total, part)
        for a, b in zip(total, whole, strict=True):
            np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-7)
    np.testing.assert_allclose(mm.block_moments(x, False)[3] / 500, np.cov(x.T, bias=True), rtol=1e-8, atol=1e-9)
    assert mm.block_moments(x, False)[3][2, 2] == 0.0


@pytest.mark.parametrize("partitions", [1, 5])
def test_moments_and_correlations_by_group(spark, partitions):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(400, 3)), columns=["a", "b", "c"])
    pdf["site"] = rng.choice(["x", "y", None], 400)
    pdf["day"] = rng.integers(0, 2, 400)
    pdf["flat"] = 0.3
    pdf.loc[rng.random(400) < 0.3, "b"] = np.nan
    rows = [tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a double, b double, c double, site string, day bigint, flat double").repartition(partitions)
    keyed = pdf.assign(site=pdf["site"].fillna("-"))
    got = {(r.site or "-", r.day): r for r in mm.complete_moments(df, ["a", "b", "c"], series=["site", "day"]).collect()}
    for key, part in keyed.groupby(["site", "day"]):
        full = part[["a", "b", "c"]].dropna()
        assert got[key].n == len(full)
        np.testing.assert_allclose(got[key].means, full.mean())
        np.testing.assert_allclose(got[key].cross, np.cov(full.T, bias=True)[np.triu_indices(3)])
    pairs = {(r.site or "-", r.col_a, r.col_b): (r.r, r.n) for r in mm.pair_correlations(df, ["a", "b", "flat"], series="site").collect()}
    for site, part in keyed.groupby("site"):
        both = part[["a", "b"]].dropna()
        r, n = pairs[site, "a", "b"]
        assert n == len(both) and r == pytest.approx(both.corr().iloc[0, 1])
        assert pairs[site, "a", "flat"] == (None, len(part))
    whole = mm.complete_moments(df, ["a", "c"]).first()
    assert whole.n == 400 and mm.complete_moments(df.where("a > 99"), ["a"]).count() == 0
