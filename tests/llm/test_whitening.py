"""Whitening against dense linear algebra on all rows at once."""

import math

import numpy as np
import pytest

from daygauge.llm import whitening as wh

SCHEMA = "vec_id bigint, embedding array<float>, n bigint, _grid string, component string"


@pytest.fixture
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, v if v is None else [None if c is None else float(c) for c in v], 5, "grid", "c") for i, v in rows], SCHEMA)

    return make


def plain(rows, dims):
    """What the contract says, with all vectors of one length in memory."""
    use = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
           if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted(set(tuple(x) for _, x in use))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * x - s) / n for x, s in zip(v, sums)] for v in fit])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    return use, n, sums, values[::-1], vectors[:, ::-1], np.trace(covariance)


def compare(got, rows, dims, components):
    use, n, sums, values, vectors, trace = plain(rows, dims)
    kept = min(dims, components)
    by_row = {}
    for r in got:
        by_row.setdefault(r["vec_id"], []).append(r)
    assert {i for i, _ in use} <= set(by_row)
    signs = None
    for i, x in use:
        mine = sorted(by_row[i], key=lambda r: r["component"])
        times = sum(j == i for j, _ in use)
        assert [r["component"] for r in mine] == [c for c in range(1, kept + 1) for _ in range(times)]
        assert {r["n"] for r in mine} == {n} and {r["deviation"] for r in mine} == {sum((n * a - s) ** 2 for a, s in zip(x, sums))}
        assert len({r["identity_error"] for r in mine}) == 1 and mine[0]["identity_error"] <= 1e-9
        want = np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ vectors[:, :kept]
        out = np.array([r["whitened"] for r in mine[::times]])
        white = values[:kept] > 1e-12 * max(values[0], 1e-300)
        want = np.where(white, want / np.sqrt(np.where(white, values[:kept], 1)), 0)
        signs = np.sign(out * want) if signs is None or not signs.all() else signs
        np.testing.assert_allclose(np.abs(out), np.abs(want), rtol=1e-9, atol=1e-9)
        if trace > 0:
            np.testing.assert_allclose([r["explained"] for r in mine[::times]], np.where(white, values[:kept], 0) / trace, rtol=1e-9, atol=1e-12)


def test_rows_of_all_kinds(vectors):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=20) * np.linspace(3, 1, 20) + 5).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(50)]  # repeated vectors count once
    rows += [(2000, None), (2001, []), (2002, [None] * 20), (2003, [math.nan, *rows[0][1][1:]]), (2004, [math.inf, *rows[0][1][1:]])]
    rows += [(3000 + i, rng.normal(size=3).tolist()) for i in range(9)]  # another length, for itself
    rows += [(4000, [1.0, 2.0])]  # one vector of its length has no variance
    rows += [(i, v) for i, v in rows[:3]]  # repeated rows
    got = wh.whiten(vectors(rows)).collect()
    assert {r["vec_id"] for r in got}.isdisjoint({2000, 2001, 2002, 2003, 2004})
    assert {r["_grid"] for r in got} == {"grid"}
    for dims in (20, 3):
        compare([r for r in got if (r["vec_id"] // 1000 == 3) == (dims == 3) and r["vec_id"] != 4000], rows, dims, 16)
    single = [r for r in got if r["vec_id"] == 4000]
    assert [(r["component"], r["whitened"], r["explained"], r["deviation"]) for r in single] == [(1, 0.0, 0.0, 0), (2, 0.0, 0.0, 0)]
    assert wh.whiten(vectors([])).count() == 0


def test_flat_and_huge_entries(vectors):
    rng = np.random.default_rng(5)
    rows = [(i, [*rng.normal(size=3).tolist(), 7.0]) for i in range(40)]
    got = wh.whiten(vectors(rows)).collect()
    compare(got, rows, 4, 16)
    assert all(r["whitened"] == 0.0 for r in got if r["component"] == 4)
    far = wh.whiten(vectors([*rows, (99, [3e38, 0.0, 0.0, 0.0])])).collect()
    assert {r["deviation"] for r in far if r["vec_id"] == 99} == {None}
    assert {r["n"] for r in far} == {41}


@pytest.mark.parametrize("values", [
    np.arange(40, 0, -1.0), np.r_[np.full(10, 5.0), np.linspace(4, 1, 30)], np.r_[5 + 1e-9 * np.arange(10), np.linspace(4, 1, 30)],
    np.r_[5 + 1e-13 * np.arange(10), 3 + 1e-6 * np.arange(10), np.linspace(2, 1, 20)], np.geomspace(1e8, 1e-6, 40), np.ones(40),
    np.r_[np.linspace(4, 1, 10), np.zeros(30)], np.array([3.0]), np.zeros(5)])
def test_eigenvectors_to_double_precision(values):
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(len(values),) * 2))[0]
    matrix = (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = wh.eigenvectors(matrix)
    exact = matrix.astype(np.longdouble)
    size = max(np.abs(values).max(), 1e-300)
    assert np.abs(exact @ vectors - vectors * found).max() <= 4e-16 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 2e-15
    np.testing.assert_allclose(found, np.linalg.eigh(matrix)[0][::-1], atol=4e-15 * size)
    assert np.all(np.diff(found) <= 0)
