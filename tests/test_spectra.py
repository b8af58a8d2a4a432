"""Davidson rounds against dense eigenvalue solves."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessella.operators import moments as G
from tessella.operators import spectra as E


def cells(spark, r):
    t, n = r.shape
    return spark.createDataFrame([(i, 10 + 3 * s, float(r[i, s])) for i in range(t) for s in range(n)], "t long, site_id long, v double").repartition(4)


def dense(r, k):
    values, vectors = G.spectrum(np.cov(r.T))
    return values[:k], vectors[:, :k]


@pytest.mark.parametrize("shape, slow", [((30, 150), False), ((400, 150), True), ((5, 3), False)])
def test_spectrum_equals_the_dense_one(spark, shape, slow):
    """With few times, with more of them than sites and a slowly falling spectrum, and in less than one block."""
    rng = np.random.default_rng(3)
    r = rng.normal(size=shape) * (np.linspace(3, 1, shape[1]) if slow else np.exp(-np.arange(shape[1]) / 9)) + 5
    k = min(6, *shape)
    table, found = E.covariance_spectrum(cells(spark, r), k)
    values, vectors = dense(r, k)
    rows = sorted(table.collect(), key=lambda x: x.component or 99)
    assert np.allclose([x.eigenvalue for x in rows[:-1]], values, rtol=1e-8, atol=1e-10) and rows[-1].component is None
    assert np.isclose(sum(x.eigenvalue for x in rows), np.trace(np.cov(r.T)))
    assert np.isclose(rows[-2].cumulative_explained_variance, values.sum() / np.trace(np.cov(r.T)))
    got = np.zeros((shape[1], k))
    for x in found.long().collect():
        got[(x.site_id - 10) // 3, x.k] = x.phi
    sure = min(k, np.linalg.matrix_rank(r - r.mean(0)))
    assert np.allclose(got[:, :sure], vectors[:, :sure], atol=1e-6)


def test_tiles_of_several_blocks_and_spans(spark):
    rng = np.random.default_rng(4)
    r = rng.normal(size=(70, 50)) @ np.diag(np.exp(-np.arange(50) / 4))
    own = E.tiled(cells(spark, r), sites=16, times=32)
    assert own.n == 70 and np.isclose(own.trace, (r * r).sum()) and own.tiles.count() == 12
    found = E.leading(own.sites, lambda x: E.product(own, x), 4)
    assert np.allclose(found.values, np.linalg.eigvalsh(r.T @ r)[::-1][:4], rtol=1e-9)


def test_no_variance_and_no_rows(spark):
    flat = cells(spark, np.ones((4, 6)))
    table, _ = E.covariance_spectrum(flat, 2)
    assert all(abs(x.eigenvalue) < 1e-12 for x in table.collect())
    with pytest.raises(ValueError):
        E.covariance_spectrum(flat.where(F.col("t") < 0), 2)
