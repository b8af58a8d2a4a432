"""Whole workloads and trials against dense versions on a small panel."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessella.operators import intervals as I
from tessella.operators import models as D
from tessella.operators import moments as G
from tessella.operators import panel as P
from tessella.operators import splines as S
from tessella.plans import workloads as L

N, T, K = 30, 40, 3
RNG = np.random.default_rng(21)
GRID = np.stack(np.meshgrid(np.arange(6), np.arange(5)), -1).reshape(-1, 2)[:N]
XY = (GRID + RNG.uniform(-0.2, 0.2, (N, 2))) / 6
MODES = np.column_stack([np.sin(3 * XY[:, 0]), np.cos(2 * XY.sum(1)), XY[:, 1] ** 2])
Z = 10 + (RNG.normal(size=(T, K)) * [3, 2, 1]) @ MODES.T + 0.2 * RNG.normal(size=(T, N))
HOLES = {(4, 2), (7, 11), (33, 5)}


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame([(t, i, float(Z[t, i])) for t in range(T) for i in range(N) if (t, i) not in HOLES], "t long, site_id long, z double")


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(XY)], "site_id long, x double, y double")


def dense(rows, value="z"):
    """The panel as a matrix, with the site's mean where nothing was seen."""
    out = np.full((T, N), np.nan)
    for r in rows:
        out[r.t, r.site_id] = r[value]
    return np.where(np.isnan(out), np.nanmean(out, 0), out)


def splits(panel):
    rows = P.attach_split(panel, P.split_contiguous(panel)).select("t", "split").distinct().collect()
    return {n: np.array(sorted(r.t for r in rows if r.split == n)) for n in ("train", "val", "test")}


def moments(x):
    return G.Moments(len(x), x.sum(0), x.T @ x, list(range(x.shape[1])))


def test_reconstruction(panel, sites):
    o = D.FitOptions(rounds=20, least_rounds=20)
    got = {(r.model, r.split, r.metric): r.value for r in L.reconstruction(panel, sites, K, 0.01, 0.0, o).collect()}
    z, of = dense(panel.collect()), splits(panel)
    mean = z[of["train"]].mean(0)
    r = z - mean
    fit = D.fit_basis(moments(r[of["train"]]), moments(r[of["val"]]), D.smoothing_matrix(XY), K, 0.01, 0.0, z[of["train"]].std(ddof=1), (z[of["train"]] ** 2).mean(), o)
    for model, hat in (("trend", np.broadcast_to(mean, z.shape)), ("trend_basis", mean + r @ fit.phi @ fit.phi.T)):
        for split, t in of.items():
            error = (z - hat)[t]
            want = {"rmse": np.sqrt((error**2).mean()), "mae": np.abs(error).mean(), "r2": 1 - (error**2).sum() / ((z[t] - z[t].mean()) ** 2).sum()}
            assert all(abs(got[model, split, m] - v) < 2e-6 for m, v in want.items())


def test_held_out_prediction(panel, sites):
    got = {r.kind: r for r in L.held_out_prediction(panel, sites, 0.2, 3, K, 0.01).collect()}
    of = splits(panel)
    held = np.array(sorted(r.site_id for r in P.split_sites(P.attach_split(panel, P.split_contiguous(panel)), 0.2, 3)[1].select("site_id").distinct().collect()))
    own = np.setdiff1d(np.arange(N), held)
    seen = np.full((T, N), np.nan)
    for r in panel.collect():
        seen[r.t, r.site_id] = r.z
    level = np.nanmean(seen[np.ix_(of["train"], own)])
    train = seen[np.ix_(of["train"], own)] - level
    train = np.where(np.isnan(train), np.nanmean(train, 0), train)
    phi = np.linalg.eigh(train.T @ train - 0.01 * D.smoothing_matrix(XY[own]))[1][:, ::-1][:, :K]
    fit = G.plug_in(moments(train), phi, rotate=True)
    basis = phi @ fit.rotation
    n, side = len(own), np.column_stack([np.ones(len(own)), XY[own]])
    system = np.block([[S.spline_kernel(S.distances(XY[own], XY[own]), 2), side], [side.T, np.zeros((3, 3))]]) + 1e-8 * np.eye(n + 3)
    w = np.linalg.solve(system, np.vstack([basis, np.zeros((3, K))]))
    there = S.spline_kernel(S.distances(XY[held], XY[own]), 2) @ w[:n] + np.column_stack([np.ones(len(held)), XY[held]]) @ w[n:]

    def predicted(times):
        rows = []
        for t in times:
            ok = np.isfinite(seen[t, own])
            cov = np.linalg.inv(np.diag(1 / (fit.eigenvalues + 1e-12)) + basis[ok].T @ basis[ok] / fit.noise + 1e-12 * np.eye(K))
            eta = cov @ basis[ok].T @ (seen[t, own][ok] - level) / fit.noise
            rows += [(seen[t, s], level + there[j] @ eta, there[j] @ cov @ there[j] + fit.noise) for j, s in enumerate(held) if np.isfinite(seen[t, s])]
        return np.array(rows).T

    y, eta, var = predicted(of["val"])
    q = np.quantile(np.abs(y - eta) / np.sqrt(var), min(1, 0.95 * (1 + 1 / len(y))))
    y, eta, var = predicted(of["test"])
    for kind, z in (("plug-in", I.normal_z(0.05)), ("calibrated", q)):
        half = z * np.sqrt(var)
        assert got[kind].n == len(y) and abs(got[kind].rmse - np.sqrt(((y - eta) ** 2).mean())) < 1e-5
        assert abs(got[kind].cp - 100 * (np.abs(y - eta) <= half).mean()) < 1e-9 and abs(got[kind].mpiw - 2 * half.mean()) < 1e-4


def test_trials_and_the_best(spark):
    r = Z - Z.mean(0)
    omega, o = D.smoothing_matrix(XY), D.FitOptions(rounds=12, least_rounds=12)
    stats = {s: (moments(r[s:24:2]), moments(r[24:]), 1.5, 2.0 + s) for s in (0, 1)}
    rows = D.run_trials(D.trial_grid(spark, [0.01, 0.1], [0.0, 0.05], [0, 1]), stats, omega, K, o).collect()
    assert len(rows) == 8
    for x in rows:
        fit = D.fit_basis(*stats[x.seed][:2], omega, K, x.tau1, x.tau2, *stats[x.seed][2:], o)
        assert abs(x.val_rmse - fit.best_rmse) < 1e-9 and x.rounds == len(fit.history)
    best = {x.seed: x.trial for x in D.best_trial(spark.createDataFrame(rows)).collect()}
    for s in (0, 1):
        own = [x for x in rows if x.seed == s]
        assert best[s] == min(own, key=lambda x: (x.val_rmse, x.trial)).trial


def test_fit_diagnostics_are_those_of_the_rows():
    r = Z - Z.mean(0)
    phi, omega = np.linalg.qr(MODES)[0], D.smoothing_matrix(XY)
    got = D.fit_diagnostics(moments(r), phi, omega, 0.3, 0.2)
    recon, smooth, l1 = ((r - r @ phi @ phi.T) ** 2).mean(), 0.3 * np.trace(phi.T @ omega @ phi), 0.2 * np.abs(phi).sum()
    assert np.allclose([got["recon_mse"], got["smooth_penalty"], got["l1_penalty"], got["total"]], [recon, smooth, l1, recon + smooth + l1])
    assert np.allclose([got["smooth_per_entry"], got["l1_over_recon"]], [smooth / (N * K), l1 / (N * K) / recon])


def test_penalised_basis_in_tiles_is_the_one_of_one_task(panel, sites, monkeypatch):
    cells = L.filled(panel).select("t", "site_id", (F.col("z") - 10).alias("v"))
    one = {(r.site_id, r.k): r.phi for r in L.penalised(cells, sites, 2, 0.001).collect()}
    monkeypatch.setattr(G, "MOST_SITES", 10)
    tiles = {(r.site_id, r.k): r.phi for r in L.penalised(cells, sites, 2, 0.001).collect()}
    for k in range(2):
        assert abs(abs(sum(one[i, k] * tiles[i, k] for i in range(N))) - 1) < 1e-6
