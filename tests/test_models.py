"""Identities: one-pass moments, low-rank fits, kriging and the basis fit against plain row forms."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessella.operators import models as D
from tessella.operators import moments as G
from tessella.operators import panel as P
from tessella.operators import spatial as X

RNG = np.random.default_rng(0)
N, T, K = 12, 60, 3
PHI = np.linalg.qr(RNG.normal(size=(N, K)))[0]
R = RNG.normal(size=(T, K)) * np.array([3.0, 2.0, 1.0]) @ PHI.T + 0.3 * RNG.normal(size=(T, N))
XY = RNG.random((N, 2))


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(t, s, float(R[t, s])) for t in range(T) for s in range(N)]
    return spark.createDataFrame(rows, "t long, site_id long, r double").repartition(5)


def basis(spark, phi):
    return spark.createDataFrame([(i, k, float(v)) for i, row in enumerate(phi) for k, v in enumerate(row)], "site_id long, k long, phi double")


def test_moments_are_those_of_the_rows(panel):
    for parts in (1, 5):
        m = G.moments(panel.repartition(parts), "r")
        assert m.n == T and np.allclose(m.gram, R.T @ R) and np.allclose(m.total, R.sum(0))
    assert np.allclose(m.covariance(), np.cov(R.T))


def test_moments_use_complete_rows_only(panel):
    m = G.moments(panel.where("NOT (t = 4 AND site_id = 2)"), "r")
    assert m.n == T - 1 and np.allclose(m.gram, np.delete(R, 4, 0).T @ np.delete(R, 4, 0))


def test_low_rank_covariance(panel):
    fit = G.low_rank(G.moments(panel, "r"), PHI)
    assert fit.rank == K
    s = fit.matrix()
    assert np.allclose(s, s.T) and np.linalg.eigvalsh(s).min() > 0
    assert np.allclose(np.diag(s), fit.variance())


def test_basis_moments_are_those_of_the_matrix(spark, panel):
    holes = panel.where("NOT (t = 4 AND site_id = 2)")
    m, long = G.moments(holes, "r"), G.basis_moments(holes, basis(spark, PHI))
    of = G.BasisMoments.of(m, PHI)
    assert (long.n, long.sites) == (of.n, of.sites) == (T - 1, N)
    assert np.isclose(long.trace, of.trace) and np.allclose(long.second, of.second) and np.allclose(long.inner, of.inner)
    for f in (G.low_rank, G.plug_in):
        a, b = f(m, PHI), f(long)
        assert a.rank == b.rank and np.isclose(a.noise, b.noise) and np.allclose(a.eigenvalues, b.eigenvalues) and np.allclose(a.rotation, b.rotation)
    row = G.residual_moments(holes, basis(spark, 2 * PHI)).first()
    s = m.gram / m.n
    assert np.allclose([row.trace, row.norm, row.basis_norm], [np.trace(s), np.linalg.norm(s), 2 * np.sqrt(K)])
    with pytest.raises(ValueError):
        G.basis_moments(panel.where("site_id <> t"), basis(spark, PHI), where=F.col("t") < 0)


def test_orthonormal_basis_is_the_nearest(spark):
    raw = RNG.normal(size=(N, K))
    got = {(r.site_id, r.k): r.phi for r in D.orthonormal(basis(spark, raw)).collect()}
    want = D.retracted(raw)
    assert len(got) == N * K and all(abs(want[i] - v) < 1e-9 for i, v in got.items())
    with pytest.raises(ValueError):
        D.orthonormal(basis(spark, np.ones((N, K))))


def test_orthogonal_data_have_no_component():
    other = np.linalg.svd(PHI)[0][:, K:]
    y = RNG.normal(size=(200, N - K)) @ other.T
    fit = G.low_rank(G.Moments(200, y.sum(0), y.T @ y, list(range(N))), PHI)
    assert fit.rank == 0 and not fit.eigenvalues.any() and np.allclose(fit.matrix(), fit.noise * np.eye(N))


def test_kriging_equals_the_full_form(spark, panel):
    m = G.moments(panel, "r")
    fit = G.low_rank(m, PHI)
    new = RNG.normal(size=(4, K))
    there = spark.createDataFrame([(100 + i, [float(x) for x in row]) for i, row in enumerate(new)], "site_id long, phi array<double>")
    mean, var = D.kriging_at(panel, basis(spark, PHI), fit, there)
    b, p = PHI @ fit.rotation, new @ fit.rotation
    lam = np.diag(fit.eigenvalues)
    gain = np.linalg.solve(b @ lam @ b.T + fit.noise * np.eye(N), b @ lam @ p.T)
    want, cov = R @ gain, p @ lam @ p.T + fit.noise * np.eye(4) - (b @ lam @ p.T).T @ gain
    got = {(r.t, r.site_id - 100): r["mean"] for r in mean.collect()}
    assert all(abs(want[t, i] - v) < 1e-8 for (t, i), v in got.items()) and len(got) == T * 4
    spread = {r.site_id - 100: r["var"] for r in var.collect()}
    assert np.allclose([spread[i] for i in range(4)], np.diag(cov))


@pytest.mark.parametrize("times, sites", [(1024, 512), (7, 5)])
def test_products_of_tall_tables(spark, panel, times, sites):
    """Also with blocks that are not full, entries that are missing, and sites without a basis row."""
    eta = spark.createDataFrame([(t, k, float(v)) for t, row in enumerate(R @ PHI) for k, v in enumerate(row) if (t + k) % 5], "t long, k long, eta double")
    dense = (R @ PHI) * [[(t + k) % 5 > 0 for k in range(K)] for t in range(T)]
    got = {(r.t, r.site_id): r.fitted for r in D.reconstructed(eta, basis(spark, PHI), times, sites).collect()}
    assert len(got) == T * N and all(abs((dense @ PHI.T)[t, i] - v) < 1e-9 for (t, i), v in got.items())
    some = basis(spark, PHI).where("site_id <> 3")
    rows = D.projected(panel, some).collect()
    left = np.delete(PHI, 3, 0)
    want = np.delete(R, 3, 1) @ left @ PHI.T
    assert len(rows) == T * N
    assert all(r.fitted is None if r.site_id == 3 else abs(want[r.t, r.site_id] - r.fitted) < 1e-9 for r in rows)


def test_no_exchange_by_component(spark, panel):
    """Neither form deals rows by k."""
    long = basis(spark, PHI)
    for df in (D.projected(panel, long), D.reconstructed(D.scores(panel, long), long)):
        assert "hashpartitioning(k#" not in df._jdf.queryExecution().toString()


def test_conditional_scores(spark, panel):
    lam, noise = np.array([9.0, 4.0, 1.0]), 0.1
    rows = panel.withColumn("r", F.when((F.col("t") > 0) & ((F.col("t") + F.col("site_id")) % 4 != 0), F.col("r"))).where("r IS NOT NULL OR t = 0")
    found = [{r.t: (np.array(r.eta), np.array(r["cov"])) for r in D.conditional(rows, basis(spark, PHI), lam, noise, block=b).collect()} for b in (4096, 5)]
    got = found[0]
    assert all(np.allclose(x, y) for t in got for x, y in zip(got[t], found[1][t]))
    seen = [s for s in range(N) if (5 + s) % 4]
    b = PHI[seen]
    cov = np.linalg.inv(np.diag(1 / lam) + b.T @ b / noise)
    assert np.allclose(got[5][1], cov, atol=1e-6) and np.allclose(got[5][0], cov @ b.T @ R[5, seen] / noise, atol=1e-6)
    assert np.allclose(got[0][0], 0) and np.allclose(got[0][1], np.diag(lam))
    new = RNG.normal(size=(3, K))
    asked = spark.createDataFrame([(t, 100 + i, 7.0) for t in (0, 5) for i in range(3)], "t long, site_id long, z double")
    there = spark.createDataFrame([(100 + i, [float(x) for x in row]) for i, row in enumerate(new)], "site_id long, phi array<double>")
    out = {(r.t, r.site_id - 100): r for r in D.predicted_at(asked, D.conditional(rows, basis(spark, PHI), lam, noise), there, noise).collect()}
    assert len(out) == 6 and all(np.isclose(r["mean"], new[i] @ got[t][0]) and np.isclose(r["var"], new[i] @ got[t][1] @ new[i] + noise) and r.z == 7 for (t, i), r in out.items())


def test_basis_fit_equals_the_row_form():
    """The same rounds with consensus and dual rows kept as rows."""
    train, val = R[:40], R[40:]
    stats = [G.Moments(len(x), x.sum(0), x.T @ x, list(range(N))) for x in (train, val)]
    omega = D.smoothing_matrix(XY)
    o = D.FitOptions(rounds=25, least_rounds=25, every=2)
    fit = D.fit_basis(*stats, omega, K, 0.5, 0.2, 1.3, 2.0, o)
    phi = D.penalised_basis(train.T @ train, omega, 0.5, K)
    z, u, zv, uv, rho, best = train.copy(), 0 * train, val.copy(), 0 * val, 5.0 * 1.3, np.inf
    for i in range(25):
        if i % 2 == 0:
            c = z - z.mean(0)
            m = c.T @ c - 0.5 * omega
            m = (m + m.T) / 2
            m = m + o.ridge * np.trace(m) / N * np.eye(N)
            phi = D._sparse(m, G.spectrum(m)[1][:, :K], 0.2, o)
        for rows, zz, uu in ((train, z, u), (val, zv, uv)):
            rest = rows - uu
            zz[:] = (rho * rest + 2 * rest @ phi @ phi.T) / (rho + 2)
            before = uu.copy()
            uu += zz - rows
            uu += o.momentum * (uu - before)
        best = min(best, np.sqrt(np.mean((val - zv @ phi @ phi.T) ** 2)))
    assert abs(best - fit.best_rmse) < 1e-9 and np.allclose(np.abs(phi.T @ fit.phi), np.eye(K), atol=1e-6)


def test_forecast_follows_the_autoregression(spark):
    a = np.array([[0.9, 0.1], [0.0, 0.5]])
    eta = [np.array([1.0, 2.0])]
    for _ in range(60):
        eta.append(a @ eta[-1] + 0.05 * RNG.normal(size=2))
    rows = spark.createDataFrame([(t, k, float(v)) for t, e in enumerate(eta) for k, v in enumerate(e)], "t long, k long, eta double")
    x, y = np.stack(eta[:-1]), np.stack(eta[1:])
    want = np.linalg.solve(x.T @ x + 1e-4 * np.eye(2), x.T @ y).T
    model = D.fit_forecaster(rows)
    assert np.allclose(model.matrix, want) and np.allclose(model.last, eta[-1])
    assert np.allclose(model.states(3)[2], want @ want @ want @ eta[-1])


def test_carried_forecasts_go_on(spark, tmp_path):
    """Two calls of two steps are one of four; a rerun of a version gives the same rows and writes nothing."""
    a = np.array([[0.9, 0.1, 0.0], [0.0, 0.5, 0.2], [0.1, 0.0, 0.7]])
    model, long = D.Forecaster(a, np.array([1.0, -2.0, 0.5])), basis(spark, PHI)
    mu = lambda steps: spark.createDataFrame([(h, s, float(s)) for h in range(1, steps + 1) for s in range(N)], "h int, site_id long, mu double")
    rows = lambda df, off=0: {(r.h + off, r.site_id): r.value for r in df.collect()}
    path = "file://" + str(tmp_path / "model")
    D.save_forecaster(spark, path, model)
    first, v1 = D.carried_forecast(path, long, mu(2))
    second, v2 = D.carried_forecast(path, long, mu(2))
    both, whole = rows(first) | rows(second, 2), rows(D.forecast(model, long, mu(4)))
    assert (v1, v2) == (1, 2) and both.keys() == whole.keys() and all(abs(both[k] - whole[k]) < 1e-12 for k in whole)
    again, v = D.carried_forecast(path, long, mu(2), version=0)
    assert v == 1 and rows(again) == rows(first) and D.model_versions(spark, path).count() == 3
    with pytest.raises(ValueError):
        D.carried_forecast(path, long, mu(3), version=1)
    assert D.claimed(spark, f"{path}/_claim-{3:012d}")
    with pytest.raises(ValueError):
        D.carried_forecast(path, long, mu(2))
    assert D.carried_forecast(path, long, mu(2), take_over=True)[1] == 3


def test_one_covariance_for_each_pattern(spark, panel):
    """Times with the same holes share a covariance, and it is that of each time by itself."""
    rows = panel.where("(t % 3 <> 1 OR site_id <> 2) AND (t % 3 <> 2 OR site_id < 5)")
    lam, noise = np.array([9.0, 4.0, 1.0]), 0.1
    _, times = D._seen(rows, basis(spark, PHI), "r", 4096)
    assert D.patterns_of(times).count() == 3
    got = {r.t: (np.array(r.eta), np.array(r["cov"])) for r in D.conditional(rows, basis(spark, PHI), lam, noise, block=5).collect()}
    seen = [range(N), [i for i in range(N) if i != 2], range(5)]
    for t in range(T):
        b = PHI[list(seen[t % 3])]
        cov = np.linalg.inv(np.diag(1 / (lam + 1e-12)) + b.T @ b / noise + 1e-12 * np.eye(K))
        assert np.allclose(got[t][1], cov) and np.allclose(got[t][0], cov @ b.T @ R[t, list(seen[t % 3])] / noise)


def test_nearest_keys_by_cells(spark):
    rng = np.random.default_rng(5)
    keys = [(float(10 ** a), float(10 ** b)) for a, b in rng.uniform(-3, 3, (400, 2))] + [(0.0, 1.0), (0.0, 0.0)]
    wanted = [(float(10 ** a), float(10 ** b)) for a, b in rng.uniform(-4, 4, (60, 2))] + [(0.0, 0.0), keys[3]]
    k, w = (spark.createDataFrame(x, "tau1 double, tau2 double") for x in (keys, wanted))
    got = [sorted(map(tuple, X.nearest_key(k, w, most=m).collect())) for m in (10_000, 10)]
    log = lambda x: np.log10(np.array(x) + 1e-12)
    want = sorted((*x, *min(keys, key=lambda y: (((log(x) - log(y)) ** 2).sum(), y))) for x in wanted)
    assert got[0] == got[1] == want


def test_matern_against_known_values():
    assert abs(X.bessel_k(1.0, np.array([1.0]))[0] - 0.60190723) < 1e-7
    assert X.matern(np.array([0.0]), 1.0)[0] == 1 and abs(X.matern(np.array([2.0]), 0.5)[0] - np.exp(-2)) < 1e-6


def test_pairs_do_not_join_everything(spark):
    sites = spark.range(500).select(F.col("id").alias("site_id"), (F.rand(1)).alias("x"), F.rand(2).alias("y"))
    plan = X.pairs_within(sites, 0.05)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_ols_on_rank_loss(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 3.0 * i + 1) for i in range(20)], "a double, b double, y double")
    w, b = D.ols(df, ["a", "b"], "y")
    assert np.allclose(w, [0.6, 1.2]) and abs(b - 1) < 1e-9


def test_best_trial_takes_the_first(spark):
    df = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (0, 2, 1.0), (1, 0, None), (1, 1, 3.0)], "seed int, trial int, val_rmse double")
    assert {(r.seed, r.trial) for r in D.best_trial(df).collect()} == {(0, 1), (1, 1)}


def test_draw_is_the_order_of_all_hashes(spark):
    got = P.draw(spark.range(5000), "id", 7).collect()
    want = sorted(range(5000), key=lambda i: hashlib.md5(f"7|{i}".encode()).hexdigest())
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == want
    assert sorted(r.place for r in got) == list(range(5000)) and {r.n for r in got} == {5000}
    assert P.draw(spark.range(0), "id", 7).count() == 0
