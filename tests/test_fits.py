"""The factored fit on tiles against the dense one."""

import numpy as np
import pytest
from tessella.operators import fits as A
from tessella.operators import models as D
from tessella.operators import moments as G
from tessella.operators import splines as S

RNG = np.random.default_rng(31)
N, K = 30, 2
GRID = np.stack(np.meshgrid(np.arange(6), np.arange(5)), -1).reshape(-1, 2)
XY = (GRID + RNG.uniform(-0.2, 0.2, (N, 2))) / 6
MODES = np.column_stack([np.sin(3 * XY[:, 0]), np.cos(2 * XY.sum(1))])
R = (RNG.normal(size=(36, K)) * [3, 1.5]) @ MODES.T + 0.1 * RNG.normal(size=(36, N)) + 0.05


def cells(spark, r):
    return spark.createDataFrame([(t, i, float(v)) for t, row in enumerate(r) for i, v in enumerate(row)], "t long, site_id long, v double")


def moments(x):
    return G.Moments(len(x), x.sum(0), x.T @ x, list(range(N)))


@pytest.mark.parametrize("tau2, rounds, every", [(0.0, 5, 3), (0.05, 1, 1)])
def test_factored_fit_equals_the_dense_one(spark, tau2, rounds, every):
    o = D.FitOptions(rounds=rounds, least_rounds=rounds, every=every, sparse_rounds=3)
    sites = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(XY)], "site_id long, x double, y double")
    omega = D.smoothing_matrix(XY)
    dense = D.fit_basis(moments(R[:26]), moments(R[26:]), omega, K, 0.01, tau2, 1.3, 2.0, o)
    tall = A.fit_tall(cells(spark, R[:26]), cells(spark, R[26:]), sites, K, 0.01, tau2, 1.3, 2.0, o, block=16)
    assert len(tall.history) == len(dense.history) == rounds
    for x, y in zip(tall.history, dense.history):
        assert all(abs(x[c] - y[c]) < 1e-6 * max(1, abs(y[c])) for c in ("primal", "dual", "change", "rmse"))
    assert abs(tall.best_rmse - dense.best_rmse) < 1e-7
    got = np.zeros((N, K))
    for r in tall.long().collect():
        got[r.site_id, r.k] = r.phi
    assert np.allclose(got, dense.phi, atol=1e-6)


def test_trace_of_the_smoothing_matrix(spark):
    sites = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(XY)], "site_id long, x double, y double")
    assert np.isclose(S.trace(S.splines(sites, block=16)), np.trace(D.smoothing_matrix(XY)), rtol=1e-4)


def test_diagnostics_equal_the_dense_ones(spark):
    sites = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(XY)], "site_id long, x double, y double")
    phi = np.linalg.qr(MODES)[0]
    long = spark.createDataFrame([(i, k, float(v)) for i, row in enumerate(phi) for k, v in enumerate(row)], "site_id long, k long, phi double")
    got, want = A.diagnostics(cells(spark, R), sites, long, 0.3, 0.2, block=16), D.fit_diagnostics(moments(R), phi, D.smoothing_matrix(XY), 0.3, 0.2)
    assert got.keys() == want.keys() and all(np.isclose(got[c], want[c], rtol=1e-6) for c in want)


def test_subspace_fit_equals_the_dense_one(spark, monkeypatch):
    """Few times, many rounds; with the subspace only products with the smoothing matrix touch tables, and no eigenvectors
    are sought on them."""
    o, r = D.FitOptions(rounds=12, least_rounds=12), R[:9]
    monkeypatch.setattr(A.spectra, "leading", None)
    sites = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(XY)], "site_id long, x double, y double")
    dense = D.fit_basis(moments(r[:6]), moments(r[6:]), D.smoothing_matrix(XY), K, 1e-4, 0.0, 1.3, 2.0, o)
    tall = A.fit_tall(cells(spark, r[:6]), cells(spark, r[6:]), sites, K, 1e-4, 0.0, 1.3, 2.0, o, block=16)
    assert len(tall.history) == len(dense.history) and abs(tall.best_rmse - dense.best_rmse) < 1e-7
    got = np.zeros((N, K))
    for x in tall.long().collect():
        got[x.site_id, x.k] = x.phi
    assert np.allclose(got, dense.phi, atol=1e-6)
