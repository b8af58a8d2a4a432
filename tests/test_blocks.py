"""Pair sums in blocks against plain matrices, with holes, several blocks and spans."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessella.operators import blocks as K
from tessella.operators import spatial as X

RNG = np.random.default_rng(9)
N, T = 23, 40
Z = np.where(RNG.random((T, N)) < 0.15, np.nan, RNG.normal(size=(T, N)) + 3)
Y = (RNG.random((T, N)) < 0.4).astype(float)
XY = RNG.random((N, 2))
SIZES = [{}, {"size": 5, "span": 7}]


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(100 + 2 * t, 7 * s, float(Z[t, s]), float(Y[t, s])) for t in range(T) for s in range(N) if np.isfinite(Z[t, s])]
    return spark.createDataFrame(rows, "t long, site_id long, z double, y double").repartition(6)


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame([(7 * i, float(x), float(y)) for i, (x, y) in enumerate(XY)], "site_id long, x double, y double")


def matrix(rows, c="v"):
    out = np.full((N, N), np.nan)
    seen = set()
    for r in rows:
        assert (r.i, r.j) not in seen
        seen.add((r.i, r.j))
        out[r.i // 7, r.j // 7] = r[c]
    return out


def covariance(z):
    seen = np.isfinite(z)
    n = seen.T.astype(float) @ seen
    v = np.where(seen, z, 0)
    return (v.T @ v - (v.T @ seen) * (seen.T @ v) / n) / (n - 1)


@pytest.mark.parametrize("sizes", SIZES)
def test_pair_sums(panel, sizes):
    rows = K.pair_sums(panel, **sizes).collect()
    seen, v = np.isfinite(Z).astype(float), np.nan_to_num(Z)
    assert np.allclose(matrix(rows), v.T @ v) and (matrix(rows, "n") == seen.T @ seen).all()
    assert np.allclose(matrix(rows, "a"), v.T @ seen) and np.allclose(matrix(rows, "b"), seen.T @ v)


@pytest.mark.parametrize("sizes", SIZES)
def test_covariance_errors(panel, sites, sizes):
    factor = 0.5 + 0.1 * (np.arange(N) * 7 % 3)
    a, b = covariance(Z), covariance(Z * factor)
    got = K.covariance_error(panel.withColumn("w", F.col("z") * (0.5 + 0.1 * (F.col("site_id") % 3))), "z", "w", **sizes).first().error
    assert np.isclose(got, np.linalg.norm(b - a) / np.linalg.norm(a))
    h = np.sqrt(((XY[:, None] - XY[None]) ** 2).sum(-1))
    truth = X.matern(h.ravel(), 1.0, 0.08).reshape(N, N)
    got = K.covariance_error_against(panel, sites, lambda h: X.matern(h.ravel(), 1.0, 0.08).reshape(h.shape), **sizes).first().error
    assert np.isclose(got, np.linalg.norm(a - truth) / np.linalg.norm(truth))


@pytest.mark.parametrize("sizes", SIZES)
@pytest.mark.parametrize("variant", ["variance_only", "full_taylor", "irls"])
def test_binary_targets(panel, variant, sizes):
    seen, z = np.isfinite(Z), Z
    p = 1 / (1 + np.exp(-z))
    if variant == "irls":
        z = z + (Y - p) / (p * (1 - p) + 1e-4)
    v, h = np.where(seen, z, 0), np.where(seen, 0.5 - Y, 0)
    n = seen.T.astype(float) @ seen
    want = (h.T @ v + v.T @ h) / 2 + v.T @ v / 8 if variant == "full_taylor" else v.T @ v - (v.T @ seen) * (seen.T @ v) / n
    assert np.allclose(matrix(K.binary_target(panel, variant, **sizes).collect()), want)
    with pytest.raises(ValueError):
        K.binary_target(panel, "other")


def test_complete_rows_give_the_dense_target(panel, spark):
    full = RNG.normal(size=(T, N))
    rows = spark.createDataFrame([(t, 7 * s, float(full[t, s]), float(Y[t, s])) for t in range(T) for s in range(N)], "t long, site_id long, z double, y double")
    centred = full - full.mean(0)
    assert np.allclose(matrix(K.binary_target(rows, "variance_only", size=9).collect()), centred.T @ centred)


def test_pairs_without_common_times(spark):
    rows = spark.createDataFrame([(0, 0, 1.0), (1, 7, 2.0), (1, 14, 3.0)], "t long, site_id long, z double")
    got = {(r.i, r.j): r.v for r in K.pair_sums(rows, size=1, span=1).collect()}
    assert got == {(0, 0): 1.0, (7, 7): 4.0, (14, 14): 9.0, (7, 14): 6.0, (14, 7): 6.0}
    assert K.pair_sums(rows.where("t > 5")).count() == 0


def test_k1_is_exact():
    """Known values, and the integral with a step 50 times finer."""
    known = {0.1: 9.853844780870606, 0.5: 1.656441120003301, 1.0: 0.601907230197235, 2.0: 0.139865881816522, 5.0: 0.00404461344545217, 10.0: 1.86487734538256e-05}
    for x, k in known.items():
        assert abs(X.bessel_k1_times_x(np.array([x]))[0] / x / k - 1) < 1e-12
    x = np.concatenate([np.geomspace(1e-3, 50, 400), [1 - 1e-12, 1.0, 1 + 1e-12]])
    assert np.allclose(X.bessel_k1_times_x(x), x * X.bessel_k(1.0, x), rtol=1e-12, atol=0)
    assert (X.bessel_k1_times_x(np.array([0.0, 1e-13])) == 1).all()


@pytest.mark.parametrize("nu, block", [(1.0, 512), (1.0, 4), (1.5, 6)])
def test_matern_by_site(sites, nu, block):
    h = np.sqrt(((XY[:, None] - XY[None]) ** 2).sum(-1))
    v = X.matern(h.ravel(), nu, 0.08).reshape(N, N)
    got = {r.site_id // 7: r for r in X.matern_by_site(sites, nu=nu, block=block).collect()}
    off = np.where(np.eye(N) > 0, -1, v)
    assert all(np.allclose([got[i]["mean"], got[i]["square"], got[i]["nearest"]], [v[i].mean(), (v[i] ** 2).sum(), off[i].max()], atol=1e-7) for i in range(N))
    pairs = {(r.i // 7, r.j // 7): r.v for r in X.matern_pairs(sites, nu=nu, block=block).collect()}
    assert len(pairs) == N * (N + 1) // 2 and all(abs(v[i, j] - x) < 1e-7 for (i, j), x in pairs.items())
