"""Tail probabilities for result tables.

Only rows of finished statistics pass through here (one per series and test), so these are small vectorised
helpers behind pandas UDFs; the statistics themselves are computed by Spark.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def incomplete_beta(a, b, x, terms: int = 400):
    """Regularised incomplete beta by Lentz's continued fraction (Abramowitz & Stegun 26.5.8)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        c = np.ones_like(z)
        d = 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d
        for m in range(1, terms + 1):
            for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                         -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + step * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + step / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                delta = d * c
                h = h * delta
            if np.nanmax(np.abs(delta - 1), initial=0.0) < 1e-15:
                break
        tail = front * h
    tail = np.where(z <= 0, 0.0, tail)
    return np.where(flip, 1 - tail, tail)


def t_two_sided(t, df):
    t, df = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(df, dtype=float))
    out = np.full(t.shape, np.nan)
    known = np.isfinite(df) & (df > 0) & ~np.isnan(t)
    finite = known & np.isfinite(t)
    out[known & np.isinf(t)] = 0.0
    if finite.any():
        out[finite] = incomplete_beta(df[finite] / 2, 0.5, df[finite] / (df[finite] + t[finite] ** 2))
    return out


def normal_two_sided(z):
    return _erfc(np.abs(np.asarray(z, dtype=float)) / math.sqrt(2))


def chi2_one_df(x):
    return _erfc(np.sqrt(np.asarray(x, dtype=float) / 2))


def kolmogorov_tail(lam, terms: int = 100):
    """Asymptotic Kolmogorov distribution; the theta-function form is used where the plain series is slow."""
    lam = np.asarray(lam, dtype=float)
    k = np.arange(1, terms + 1)
    safe = np.where(lam > 0, lam, 1.0)[..., None]
    plain = 2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k**2 * safe**2), axis=-1)
    theta = 1 - math.sqrt(2 * math.pi) / safe[..., 0] * np.sum(
        np.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * safe**2)), axis=-1)
    return np.clip(np.where(lam <= 0, 1.0, np.where(lam < 1.0, theta, plain)), 0.0, 1.0)


def one_sample_ks_tail(d: float, n: int) -> float:
    """P(D_n >= d) of the one-sample statistic, by the power of a small matrix for few rows and by the series beyond."""
    if d >= 1:
        return 0.0
    if n * d <= 0.5:
        return 1.0
    return matrix_ks_tail(d, n) if n <= SERIES_KS_ROWS else series_ks_tail(d, n)


def matrix_ks_tail(d: float, n: int) -> float:
    """Durbin's matrix: n!/n^n times the middle entry of H^n, where H moves the count of points along the band of width d."""
    k = math.floor(n * d) + 1
    size, h = 2 * k - 1, k - n * d
    i, j = np.indices((size, size))
    step = i - j + 1
    matrix = np.where(step >= 0, 1.0, 0.0)
    low = h ** np.arange(1, size + 1)
    matrix[:, 0] -= low
    matrix[-1, :] -= low[::-1]
    matrix[-1, 0] += (2 * h - 1) ** size if 2 * h > 1 else 0.0
    logs = np.array([math.lgamma(x + 1) for x in range(size + 1)])
    matrix *= np.exp(-logs[np.clip(step, 0, size)])
    power, scale, rest = np.eye(size), 0.0, n
    square, grown = matrix, 0.0
    while rest:
        if rest & 1:
            power, scale = power @ square, scale + grown
            top = np.abs(power).max()
            power, scale = power / top, scale + math.log(top)
        square, grown, rest = square @ square, 2 * grown, rest >> 1
        top = np.abs(square).max()
        square, grown = square / top, grown + math.log(top)
    entry = power[k - 1, k - 1]
    if entry <= 0:
        return 1.0
    return min(1.0, max(0.0, -math.expm1(math.log(entry) + scale + math.lgamma(n + 1) - n * math.log(n))))


def series_ks_tail(d: float, n: float, terms: int = 30) -> float:
    """Pelz and Good's series: the limit law with corrections of order n**-1/2, n**-1 and n**-3/2; its coefficients are fixed values."""
    z = math.sqrt(n) * d
    if z <= 0 or z > 6:  # beyond, P is below 1e-30
        return float(z <= 0)
    k = np.arange(-terms, terms + 1)
    odd, even = (np.pi * (k + 0.5)) ** 2, (np.pi * k) ** 2
    at_odd, at_even = np.exp(-odd / (2 * z * z)), np.exp(-even / (2 * z * z))
    root = math.sqrt(math.pi / 2)
    k0 = root / z * at_odd.sum()
    k1 = root / (6 * z**4) * ((odd - z**2) * at_odd).sum()
    k2 = (root / (72 * z**7) * ((6 * z**6 + 2 * z**4 + (2 * z**4 - 5 * z**2) * odd + (1 - 2 * z**2) * odd**2) * at_odd).sum()
          - root / (36 * z**3) * (even * at_even).sum())
    k3 = (root / (6480 * z**10) * (((5 - 30 * z**2) * odd**3 + (212 * z**4 - 60 * z**2) * odd**2 + (135 * z**4 - 96 * z**6) * odd
                                    - (30 * z**6 + 90 * z**8)) * at_odd).sum()
          + root / (108 * z**6) * ((3 * z**2 * even - even**2) * at_even).sum())
    return float(min(1.0, max(0.0, 1.0 - (k0 + k1 / math.sqrt(n) + k2 / n + k3 / n**1.5))))


#: Rows a side up to which "auto" counts paths, and rows of the one-sample law from which its series is used.
EXACT_KS_ROWS, SERIES_KS_ROWS = 10_000, 140
KS_LAWS = ("auto", "exact", "finite", "series", "limit")


def ks_law(law: str, m: float, n: float) -> str:
    """The law that ``auto`` stands for: exact up to EXACT_KS_ROWS rows a side, the finite one-sample law beyond."""
    return law if law != "auto" else "exact" if max(m, n) <= EXACT_KS_ROWS else "finite"


def two_sample_ks_p(d: float, m: int, n: int, law: str = "auto") -> float:
    """P(D >= d) of the two-sample test.

    ``exact`` counts paths; ``finite`` is the law of the one-sample statistic of round(mn / (m + n)) rows, ``series`` its series for any
    number of rows, ``limit`` Kolmogorov's. The exact law counts the lattice paths from (0, 0) to (m, n) that stay closer to the
    diagonal than d. For each step on one side the reachable places on the other form a short band, over which the counts are a
    cumulative sum.
    """
    if not (m > 0 and n > 0 and d == d):
        return math.nan
    m, n = int(m), int(n)
    law = ks_law(law, m, n)
    if law == "limit":
        return float(kolmogorov_tail(d * math.sqrt(m * n / (m + n))))
    if law == "finite":
        return one_sample_ks_tail(d, max(round(m * n / (m + n)), 1))
    if law == "series":
        return series_ks_tail(d, m * n / (m + n))
    reach = math.floor(d * m * n - 1e-7)
    if reach < 0:
        return 1.0
    paths, log_scale = np.zeros(n + 1), 0.0
    paths[:min(n, reach // m) + 1] = 1.0
    for i in range(1, m + 1):
        band = paths[max(0, -((reach - i * n) // m)):min(n, (i * n + reach) // m) + 1]
        np.cumsum(band, out=band)
        if i % 16 == 0 or i == m:
            top = band.max(initial=0.0)
            if top <= 0:
                return 1.0
            band /= top
            log_scale += math.log(top)
    if paths[-1] <= 0:
        return 1.0
    all_paths = math.lgamma(m + n + 1) - math.lgamma(m + 1) - math.lgamma(n + 1)
    return min(1.0, max(0.0, -math.expm1(math.log(paths[-1]) + log_scale - all_paths)))


# MacKinnon (1994, 2010) response surface for one series with a constant.
MACKINNON_MIN, MACKINNON_MAX, MACKINNON_SWITCH = -18.83, 2.74, -1.61
MACKINNON_SMALL_P = (2.1659, 1.4412, 0.038269)
MACKINNON_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def mackinnon_p(tau: float) -> float:
    if tau > MACKINNON_MAX:
        return 1.0
    if tau < MACKINNON_MIN:
        return 0.0
    poly = MACKINNON_SMALL_P if tau <= MACKINNON_SWITCH else MACKINNON_LARGE_P
    z = sum(c * tau**i for i, c in enumerate(poly))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _numeric(*columns: pd.Series) -> list[np.ndarray]:
    return [c.to_numpy(dtype=float, na_value=np.nan) for c in columns]


@F.pandas_udf(T.DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(*_numeric(t, df)))


@F.pandas_udf(T.DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return pd.Series(normal_two_sided(*_numeric(z)))


@F.pandas_udf(T.DoubleType())
def _chi2_p(x: pd.Series) -> pd.Series:
    return pd.Series(chi2_one_df(*_numeric(x)))


@F.pandas_udf(T.DoubleType())
def _ks_p(d: pd.Series, m: pd.Series, n: pd.Series, law: pd.Series) -> pd.Series:
    return pd.Series([two_sample_ks_p(*row) for row in zip(*_numeric(d, m, n), law, strict=True)], dtype=float)


def _null_safe(p: Column) -> Column:
    return F.when(~F.isnan(p), p)


def t_p(t: Column, df: Column) -> Column:
    return _null_safe(_t_p(t.cast("double"), df.cast("double")))


def normal_p(z: Column) -> Column:
    return _null_safe(_normal_p(z.cast("double")))


def chi2_p(x: Column) -> Column:
    return _null_safe(_chi2_p(x.cast("double")))


def ks_p(d: Column, m: Column, n: Column, law: str = "auto") -> Column:
    if law not in KS_LAWS:
        raise ValueError(f"law must be one of {KS_LAWS}")
    return _null_safe(_ks_p(d.cast("double"), m.cast("double"), n.cast("double"), F.lit(law)))


def ks_law_used(m: Column, n: Column, law: str = "auto") -> Column:
    return F.lit(law) if law != "auto" else F.when(F.greatest(m, n) <= EXACT_KS_ROWS, "exact").otherwise("finite")


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation coefficient by the t distribution with n-2 degrees of freedom."""
    r, df = r.cast("double"), n.cast("double") - 2
    room = (1 - r) * (1 + r)
    t = F.when(room > 0, r * F.sqrt(F.when(df > 0, df) / F.when(room > 0, room))).when(
        r.isNotNull(), F.lit(float("inf")))
    return t_p(t, df)
