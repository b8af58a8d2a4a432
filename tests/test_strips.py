"""What is asked of all pairs of sites against plain matrices, over several strips, blocks and spans."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessella.functions import storage
from tessella.operators import blocks as K
from tessella.operators import moments as G
from tessella.operators import spatial as X
from tessella.operators import strips

RNG = np.random.default_rng(12)
N, T = 41, 17
Z = np.where(RNG.random((T, N)) < 0.2, np.nan, RNG.normal(size=(T, N)) * 2 + 30)
XY = RNG.random((N, 2))
SIZES = [{}, {"size": 4, "strip": 12}, {"size": 6, "strip": 6}, {"size": 7, "span": 5}]
SEEN = np.isfinite(Z)


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame([(50 + t, 3 * s, float(Z[t, s])) for t in range(T) for s in range(N) if SEEN[t, s]], "t long, site_id long, z double").repartition(3)


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame([(3 * i, *map(float, p)) for i, p in enumerate(XY)], "site_id long, x double, y double")


def covariance():
    n = SEEN.T.astype(float) @ SEEN
    v = np.where(SEEN, Z, 0)
    with np.errstate(all="ignore"):
        return np.where(n > 1, (v.T @ v - (v.T @ SEEN) * (SEEN.T @ v) / n) / (n - 1), np.nan)


@pytest.mark.parametrize("sizes", SIZES)
def test_pair_sums(panel, sizes):
    rows, v = K.pair_sums(panel, **sizes).collect(), np.where(SEEN, Z, 0)
    got = {(r.i // 3, r.j // 3): r for r in rows}
    n = SEEN.T.astype(int) @ SEEN
    assert len(rows) == len(got) == (n > 0).sum()
    assert all(np.allclose([r.v, r.n, r.a, r.b], [v[:, i] @ v[:, j], n[i, j], v[:, i] @ SEEN[:, j], SEEN[:, i] @ v[:, j]]) for (i, j), r in got.items())


@pytest.mark.parametrize("sizes", SIZES)
def test_errors_and_distances(panel, sizes):
    v, c = np.where(SEEN, Z, 0), covariance()
    got = K.covariance_error(panel.withColumn("w", F.col("z") * 0.5), "z", "w", **sizes).first().error
    assert np.isclose(got, 0.75)
    want = np.linalg.norm(np.nan_to_num(c) - np.tril(v.T @ v))
    assert np.isclose(K.distance_to_lower_gram(panel, **sizes).first().distance, want)
    assert np.isclose(K.square_sum(panel, "z", **sizes).first().norm, np.linalg.norm(v.T @ v))


@pytest.mark.parametrize("sizes, few", [({}, 10_000), ({"size": 4, "strip": 12}, 1), ({"size": 7, "span": 5}, 0)])
@pytest.mark.parametrize("level", [0.0, 0.5, 0.95, 1.0])
def test_quantile_of_covariances_is_exact(panel, sizes, few, level):
    c = np.abs(covariance())[~np.eye(N, dtype=bool)]
    assert np.isclose(K.off_diagonal(panel, level, few=few, **sizes).first().value, np.quantile(c[np.isfinite(c)], level), rtol=1e-12)


def test_quantile_of_equal_values_and_of_none(spark):
    rows = spark.createDataFrame([(t, s, 1.0) for t in range(4) for s in range(5)], "t long, site_id long, z double")
    assert K.off_diagonal(rows, 0.95).first().value == 0
    assert K.off_diagonal(rows.where("t = 0"), 0.95).first().value is None


@pytest.mark.parametrize("estimator", ["matheron", "cressie"])
@pytest.mark.parametrize("sizes", [{}, {"block": 4, "strip": 12}, {"block": 5, "span": 6}])
def test_semivariogram(panel, sites, estimator, sizes):
    edges = [0.0, 0.1, 0.25, 0.3, 0.5]
    got = {r.bin: r for r in X.semivariogram(panel, sites, edges, estimator=estimator, **sizes).collect()}
    h = np.sqrt(((XY[:, None] - XY[None]) ** 2).sum(-1))
    for b, (lo, hi) in enumerate(zip(edges, edges[1:])):
        d = np.array([abs(Z[t, i] - Z[t, j]) for i in range(N) for j in range(i) if lo <= h[i, j] < hi for t in range(T) if SEEN[t, i] and SEEN[t, j]])
        n = len(d)
        want = (d**2).mean() / 2 if estimator == "matheron" else 0.5 * np.sqrt(d).mean() ** 4 / (0.457 + 0.494 / n + 0.045 / n**2)
        assert got[b].n == n and np.isclose(got[b].gamma, want) and np.isclose(got[b].lag, (lo + hi) / 2)


def test_semivariogram_of_counts_whose_square_leaves_64_bits(spark, monkeypatch):
    """A bin of 4e9 pairs and times: what the strips leave is stood in for."""
    rows = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0)], "t long, site_id long, z double")
    places = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.1, 0.0)], "site_id long, x double, y double")
    monkeypatch.setattr(strips.Strips, "met", lambda *_: spark.createDataFrame([(0, 8e9, 4_000_000_000)], "bin int, total double, n long"))
    assert np.isclose(X.semivariogram(rows, places, [0.0, 1.0], estimator="cressie").first().gamma, 0.5 * 2.0**4 / 0.457)


@pytest.mark.parametrize("sites_n, times", [(9, 30), (30, 9)])
def test_residual_moments_form_the_smaller_matrix(spark, sites_n, times):
    r = RNG.normal(size=(times, sites_n))
    rows = spark.createDataFrame([(t, s, float(r[t, s])) for t in range(times) for s in range(sites_n)], "t long, site_id long, r double")
    got = G.residual_moments(rows).first()
    assert np.isclose(got.norm, np.linalg.norm(r.T @ r) / times) and np.isclose(got.trace, (r * r).sum() / times) and got.basis_norm == 0


def written_bytes(spark):
    root = storage.new_folder(spark).removeprefix("file://").rsplit("/", 1)[0]
    return sum(os.path.getsize(f) for f in glob.glob(f"{root}/*/*.parquet"))


def test_nothing_of_the_pairs_is_written(spark):
    """600 sites and 3 times: a matrix of all pairs has 2.9 MB, the panel 14 kB."""
    rows = spark.range(1800).select((F.col("id") % 3).alias("t"), F.floor(F.col("id") / 3).alias("site_id"), F.rand(5).alias("z"))
    places = rows.select("site_id").distinct().select("site_id", F.rand(1).alias("x"), F.rand(2).alias("y"))
    before = written_bytes(spark)
    K.covariance_error(rows.withColumn("w", F.col("z") * 0.5), "z", "w").collect()
    K.distance_to_lower_gram(rows).collect()
    K.off_diagonal(rows, 0.9).collect()
    X.semivariogram(rows, places, [0.0, 0.2, 0.4]).collect()
    assert K.pair_sums(rows).count() == 360_000
    assert written_bytes(spark) - before < 600_000
