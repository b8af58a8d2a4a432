"""Splines on tiles against dense solves."""

import numpy as np
import pytest
from tessella.operators import models as D
from tessella.operators import spectra as E
from tessella.operators import splines as S

RNG = np.random.default_rng(6)
N, K = 60, 3


def frame(spark, xy, first=0):
    return spark.createDataFrame([(first + 2 * i, *map(float, p)) for i, p in enumerate(xy)], "site_id long, " + ", ".join(f"{c} double" for c in "xyz"[: xy.shape[1]]))


def long(spark, phi):
    return spark.createDataFrame([(2 * i, k, float(v)) for i, row in enumerate(phi) for k, v in enumerate(row)], "site_id long, k long, phi double")


def places(n, d):
    """Near a grid, none close to another, as the dense system is badly conditioned if any are."""
    side = int(np.ceil(n ** (1 / d)))
    grid = np.stack(np.meshgrid(*[np.arange(side)] * d), -1).reshape(-1, d)[RNG.permutation(side**d)[:n]]
    return (grid + RNG.uniform(-0.25, 0.25, (n, d))) / side * 3 - 1


def dense(xy, phi, at):
    n, d = xy.shape
    side = np.column_stack([np.ones(n), xy])
    system = np.block([[S.spline_kernel(S.distances(xy, xy), d), side], [side.T, np.zeros((d + 1, d + 1))]]) + 1e-8 * np.eye(n + d + 1)
    w = np.linalg.solve(system, np.vstack([phi, np.zeros((d + 1, phi.shape[1]))]))
    return w[:n], S.spline_kernel(S.distances(at, xy), d) @ w[:n] + np.column_stack([np.ones(len(at)), at]) @ w[n:]


@pytest.mark.parametrize("d, block", [(2, 512), (2, 17), (1, 25), (3, 25)])
def test_splines_equal_the_dense_solve(spark, d, block):
    xy, at = places(N, d), RNG.random((9, d)) * 3 - 1
    phi = np.column_stack([np.sin(xy.sum(1)), np.cos(2 * xy[:, 0]), xy[:, -1] ** 2])
    names = "xyz"[:d]
    s = S.splines(frame(spark, xy), names, block)
    w, values = dense(xy, phi, at)
    columns = S.columns_of(s, long(spark, phi)).persist()
    table, _ = S.weights(s, columns)
    blocks = {r.sb: np.frombuffer(r.x).reshape(r.n, K) for r in table.collect()}
    got = np.concatenate([blocks[b] for b in sorted(blocks)])
    assert np.allclose(got, w, rtol=1e-5, atol=1e-6 * np.abs(w).max())
    new = {r.site_id: np.array(r.phi) for r in S.interpolated(s, long(spark, phi), frame(spark, at, 1001), names, block).collect()}
    assert all(np.allclose(new[1001 + 2 * i], values[i], rtol=1e-6, atol=1e-6) for i in range(9)) and len(new) == 9
    omega = D.smoothing_matrix(xy)
    table = S.roughness(s, columns)
    blocks = {r.sb: np.frombuffer(r.x).reshape(r.n, K) for r in table.collect()}
    got = np.concatenate([blocks[b] for b in sorted(blocks)])
    assert np.allclose(got, omega @ phi, rtol=1e-5, atol=1e-6 * np.abs(omega @ phi).max())


def test_penalised_basis_equals_the_dense_one(spark):
    """Over several blocks; a penalty that moves the basis."""
    xy = places(N, 2)
    r = RNG.normal(size=(80, N)) @ np.diag(np.exp(-np.arange(N) / 3))
    cells = spark.createDataFrame([(t, 2 * i, float(r[t, i])) for t in range(80) for i in range(N)], "t long, site_id long, v double")
    omega = D.smoothing_matrix(xy)
    for tau1 in (0.05,):
        found, _ = S.penalised(cells, frame(spark, xy), K, tau1, block=25)
        values, vectors = np.linalg.eigh(r.T @ r - tau1 * omega)
        assert np.allclose(found.values, values[::-1][:K], rtol=1e-6)
        got = np.zeros((N, K))
        for x in found.long().collect():
            got[x.site_id // 2, x.k] = x.phi
        assert np.allclose(np.abs(np.sum(got * vectors[:, ::-1][:, :K], 0)), 1, atol=1e-6)
    assert isinstance(found, E.Leading)
