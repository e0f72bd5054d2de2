import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from daygauge.functions import distributions as di
from daygauge.functions import scalars as sc


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize("temp,humidity,want", [(18, 44, 62.4288), (27.5, 65, 76.97625), (-4, 30, 37.582), (12, 100, 53.6)])
def test_discomfort_golden(spark, temp, humidity, want):
    assert one(spark, sc.discomfort_index(F.lit(float(temp)), F.lit(float(humidity)))).c0 == pytest.approx(want, abs=1e-9)


def test_discomfort_custom_and_monotone(spark):
    got = one(spark, sc.discomfort_index(F.lit(16.0), F.lit(55.0), (0.7, 0.01, -0.2, 48.0))).c0
    assert got == pytest.approx(0.7 * 16 + 0.01 * 16 * 55 - 0.2 * 55 + 48)
    values = [one(spark, sc.discomfort_index(F.lit(float(t)), F.lit(48.0))).c0 for t in (9, 13, 31, 33)]
    assert values == sorted(values)


def chill(t, v):
    v = max(v * 3.6, 0.1)
    return 13.12 + 0.6215 * t - 11.37 * v**0.16 + 0.3965 * t * v**0.16


def test_wind_chill(spark):
    row = one(spark, *[sc.wind_chill(F.lit(t), F.lit(v)) for t, v in ((-5.0, 5.0), (-5.0, 10.0), (15.0, 8.0), (-5.0, 1.0))],
              sc.wind_chill(F.lit(3.0), F.lit(None).cast("double")))
    assert row.c0 == pytest.approx(chill(-5, 5)) and row.c0 < -5
    assert row.c1 < row.c0
    assert (row.c2, row.c3, row.c4) == (15.0, -5.0, 3.0)


def test_severity(spark):
    null = F.lit(None).cast("double")
    row = one(spark, *[sc.weather_severity(F.lit(p), F.lit(w)) for p, w in ((0.0, 2.0), (15.0, 12.0), (1.0, 2.0), (0.0, 9.0))],
              sc.weather_severity(null, F.lit(9.0)))
    assert tuple(row) == (0, 3, 1, 1, 1)


def test_null_rules(spark):
    null = F.lit(None).cast("double")
    row = one(spark, sc.flag(null > 0), sc.number(F.lit("--")), sc.number(F.lit("4.5")), sc.number(F.lit("nan")), sc.first_number(F.lit("a 10 of 12")),
              sc.first_number(null), sc.joined_text([F.lit("a"), null, F.lit("c")]), sc.day_of(F.lit("no date")))
    assert tuple(row) == (0, None, 4.5, None, 10.0, None, "a  c", None)


def test_constant_column_has_no_correlation(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "a double, b double")
    assert rows.agg(sc.pearson("a", "b")).first()[0] is None


def test_cells_and_bins(spark):
    row = one(spark, *[sc.clean_cell(F.lit(x)) for x in ("--", " 12.5 )", "3]", "///", "#", "7")], sc.hour_ending(F.lit("2024-02-28").cast("date"), F.lit(24)),
              sc.cut(F.lit(5000), (0, 5000, 8000), ("a", "b")), sc.cut(F.lit(0), (0, 5000, 8000), ("a", "b")))
    assert tuple(row)[:6] == ("", "12.5", "3", "", "", "7")
    assert str(row.c6) == "2024-02-29 00:00:00" and row.c7 == "a" and row.c8 is None


def test_words(spark):
    row = one(spark, sc.first_word(F.lit("quiet and empty"), ["empty", "quiet"]), sc.contains_any(F.lit(None).cast("string"), ["x"]),
              sc.matches_any([F.lit("north gate"), F.lit(None).cast("string")], "gate|dome"))
    assert tuple(row) == ("empty", False, True)


def test_stars_and_bands(spark):
    row = one(spark, *[sc.stars(F.lit(p)) for p in (0.0005, 0.005, 0.03, 0.2)], sc.effect_size(F.lit(1.0)), sc.effect_band(F.lit(0.2)),
              sc.signal_band(F.lit(-0.5)))
    assert tuple(row) == ("***", "**", "*", "", math.inf, "medium", "strong")


def test_tails():
    assert di.t_two_sided(2, 50) == pytest.approx(0.05094707, abs=1e-7)
    assert di.t_two_sided(12.706, 1) == pytest.approx(0.05, abs=1e-5)
    assert di.chi2_one_df(3.84) == pytest.approx(0.050044, abs=1e-6)
    assert di.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert di.kolmogorov_tail(1.358) == pytest.approx(0.05, abs=2e-4)
    x = np.linspace(-6, 6, 25)
    numeric = [1 - 2 * np.trapezoid([math.gamma(4) / (math.sqrt(7 * math.pi) * math.gamma(3.5)) * (1 + u * u / 7) ** -4
                                     for u in np.linspace(0, abs(t), 4001)], np.linspace(0, abs(t), 4001)) for t in x]
    assert np.allclose(di.t_two_sided(x, 7), numeric, atol=1e-7)


@pytest.mark.parametrize("tau,want", [(-2.86, 0.05), (-3.43, 0.01), (-2.57, 0.10)])
def test_unit_root_tail(tau, want):
    assert di.mackinnon_p(tau) == pytest.approx(want, abs=0.002)


@pytest.mark.parametrize("m,n", [(3, 4), (4, 4), (5, 3)])
def test_exact_ks_by_enumeration(m, n):
    reach = []
    for ups in itertools.combinations(range(m + n), m):
        i = j = top = 0
        for s in range(m + n):
            i, j = (i + 1, j) if s in ups else (i, j + 1)
            top = max(top, abs(i * n - j * m))
        reach.append(top)
    for k in range(1, m * n + 1):
        want = sum(t >= k for t in reach) / len(reach)
        assert di.two_sample_ks_p(k / (m * n), m, n) == pytest.approx(want, abs=1e-12)


def brute_one_sample_tail(d, n):
    """P(D_n >= d) by Noe's recursion over the counts that the band allows at each of its corners, in exact fractions."""
    from fractions import Fraction
    from math import comb

    d = Fraction(d)
    cuts = sorted({Fraction(0), Fraction(1), *[min(max(Fraction(i, n) + s * d, Fraction(0)), Fraction(1)) for i in range(n + 1) for s in (-1, 1)]})
    ways = {0: Fraction(1)}
    for low, high in zip(cuts, cuts[1:]):
        after = {}
        for have, weight in ways.items():
            for more in range(n - have + 1):
                count = have + more
                # within (low, high) the empirical law must stay closer than d; counts at the corners decide
                if not (Fraction(count, n) - high < d and high - Fraction(count, n) < d or high == 1) or high == 1 and count != n:
                    continue
                p = weight * comb(n - have, more) * ((high - low) / (1 - low)) ** more * ((1 - high) / (1 - low)) ** (n - have - more)
                after[count] = after.get(count, 0) + p
        ways = after
    return float(1 - ways.get(n, 0))


def test_one_sample_law():
    for n, d in ((3, 0.4), (5, 0.31), (8, 0.25), (12, 0.4)):
        assert di.matrix_ks_tail(d, n) == pytest.approx(brute_one_sample_tail(d, n), abs=1e-9)
    for n in (141, 300, 900):  # the series meets the matrix where both can be had
        for z in (0.5, 0.8, 1.2, 1.6, 2.2):
            assert di.series_ks_tail(z / math.sqrt(n), n) == pytest.approx(di.matrix_ks_tail(z / math.sqrt(n), n), abs=1e-5)
    assert di.one_sample_ks_tail(1.0, 50) == 0.0 and di.one_sample_ks_tail(0.004, 100) == 1.0
    assert di.series_ks_tail(1e-9, 10**6) == 1.0 and di.series_ks_tail(0.01, 10**8) == 0.0


def test_two_sample_laws_on_both_sides_of_the_switch():
    for m, n, d in ((9_990, 9_995, 0.02), (10_010, 9_995, 0.02), (10_001, 40, 0.2)):
        exact, finite = (di.two_sample_ks_p(d, m, n, law) for law in ("exact", "finite"))
        assert di.two_sample_ks_p(d, m, n) == (exact if max(m, n) <= 10_000 else finite)
        assert finite == pytest.approx(exact, abs=0.012)
        assert di.two_sample_ks_p(d, m, n, "series") == pytest.approx(finite, abs=5e-3)
