"""Regression, bases, projection, kriging, forecasts and features.

Anything that grows with times or sites is a DataFrame job; what is left is K x K and solved on the driver.
The dense fits here are for up to ``moments.MOST_SITES`` sites, in one task; ``fits`` and ``splines`` take over
beyond."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import logit
from tessella.functions.storage import written
from tessella.functions.tasks import in_task
from tessella.operators.moments import LowRank, Moments, crossed, spectrum
from tessella.operators.panel import index_of
from tessella.operators.splines import distances, spline_kernel

# ---------------------------------------------------------------- regression


def ols(df: DataFrame, features: Sequence[str], target: str) -> tuple[np.ndarray, float]:
    """Weights and intercept from centred cross-products; the least-norm solution on rank loss."""
    names = [*features, target]
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    p = len(features)
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)], float)
    mean = np.array([row[f"m{i}"] for i in range(p + 1)], float)
    w = np.linalg.lstsq(cov[:p, :p], cov[:p, p], rcond=None)[0]
    return w, float(mean[p] - mean[:p] @ w)


def ols_predict(features: Sequence[str], w: Sequence[float], b: float) -> Column:
    return sum((float(x) * F.col(c) for c, x in zip(features, w)), F.lit(float(b)))


# ---------------------------------------------------------------- smoothing and interpolation


def _spline_system(xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, d = xy.shape
    kernel = spline_kernel(distances(xy, xy), d)
    side = np.column_stack([np.ones(n), xy])
    return kernel, np.block([[kernel, side], [side.T, np.zeros((d + 1, d + 1))]]) + 1e-8 * np.eye(n + d + 1)


def smoothing_matrix(xy: np.ndarray) -> np.ndarray:
    """Thin-plate roughness of functions on the sites."""
    kernel, system = _spline_system(xy)
    inner = np.linalg.inv(system)[: len(xy), : len(xy)]
    return inner.T @ kernel @ inner


# ---------------------------------------------------------------- basis fits


def retracted(matrix: np.ndarray) -> np.ndarray:
    """The nearest matrix with orthonormal columns."""
    u, _, vt = np.linalg.svd(matrix, full_matrices=False)
    return u @ vt


def rotated(phi: DataFrame, matrix: np.ndarray) -> DataFrame:
    """A long basis (site_id, k, phi) times a k x k matrix."""
    k, m = matrix.shape
    table = phi.sparkSession.createDataFrame([(i, j, float(matrix[i, j])) for i in range(k) for j in range(m)], "k long, to long, w double")
    return phi.join(F.broadcast(table), "k").groupBy("site_id", F.col("to").alias("k")).agg(F.sum(F.col("phi") * F.col("w")).alias("phi"))


def orthonormal(phi: DataFrame) -> DataFrame:
    """The nearest long basis (site_id, k, phi) with orthonormal columns, phi (phi'phi)^-1/2: one k x k aggregate
    and a join with its inverse root, whatever the number of sites."""
    values, vectors = np.linalg.eigh(crossed(phi, "site_id", "phi"))
    if not len(values) or values[0] <= 1e-12 * values[-1]:
        raise ValueError("the basis needs independent columns")
    return rotated(phi, (vectors / np.sqrt(values)) @ vectors.T)


def basis_from(matrix: np.ndarray, n: int, k: int) -> np.ndarray:
    if matrix.shape != (n, k) or k > n:
        raise ValueError(f"the basis has shape ({n}, {k})")
    return retracted(matrix)


def penalised_basis(gram: np.ndarray, omega: np.ndarray, tau1: float, k: int) -> np.ndarray:
    """The k leading eigenvectors of R'R - tau1 * omega."""
    if k > len(gram):
        raise ValueError("no more basis columns than sites")
    return spectrum(gram - tau1 * omega)[1][:, :k]


@dataclass
class FitOptions:
    rho: float = 5.0
    momentum: float = 0.2
    rounds: int = 300
    least_rounds: int = 100
    tolerance: float = 1e-4
    every: int = 5
    freeze: int = 100
    ridge: float = 1e-6
    sparse_rounds: int = 10
    sparse_eps: float = 1e-6
    sparse_tolerance: float = 5e-4


@dataclass
class BasisFit:
    phi: np.ndarray
    best_rmse: float
    history: list[dict] = field(default_factory=list)


def _sparse(m: np.ndarray, phi: np.ndarray, tau2: float, o: FitOptions) -> np.ndarray:
    """Reweighted soft thresholds after gradient steps, each back to orthonormal columns."""
    step = 1 / (2 * np.linalg.norm(m, 2))
    for t in range(o.sparse_rounds):
        moved = phi + 2 * step * (m @ phi)
        cut = step * tau2 / (np.abs(phi) + o.sparse_eps)
        new = retracted(np.sign(moved) * np.maximum(np.abs(moved) - cut, 0))
        change, phi = np.linalg.norm(new - phi), new
        if t >= 2 and change < o.sparse_tolerance:
            break
    return phi


def fit_basis(train: Moments, val: Moments, omega: np.ndarray, k: int, tau1: float, tau2: float, y_sd: float, y_square: float, options: FitOptions | None = None, sites: int | None = None, outside: float = 0.0) -> BasisFit:
    """The regularised basis of residuals, from second moments alone.

    Moments and ``omega`` may be those of a subspace that holds all train rows and the basis; then ``sites`` is the number
    of sites, and ``outside`` the sum of squares of the val rows outside of it.

    With a fixed trend and whole batches, consensus and dual rows stay linear in the residual rows
    (Z = R a, U = R b), so each round works on N x N matrices; ``y_sd`` scales the penalty and
    ``y_square`` (mean y^2) the dual tolerance."""
    o = options or FitOptions()
    n = len(train.gram)
    sites = sites or n
    gram, centred, cells = train.gram, train.centred, max(1, train.n * sites)
    phi = penalised_basis(gram, omega, tau1, k)
    eye = np.eye(n)
    a, b, rho, best, history = eye.copy(), np.zeros((n, n)), o.rho * y_sd, np.inf, []
    size = lambda x: float(np.sqrt(max(0.0, np.sum(x * (gram @ x)) / cells)))
    for i in range(o.rounds):
        before, change = a, 0.0
        if i % o.every == 0 and i < o.freeze:
            m = a.T @ centred @ a - tau1 * omega
            m = (m + m.T) / 2
            m = m + o.ridge * np.trace(m) / sites * eye
            new = spectrum(m)[1][:, :k]
            new = _sparse(m, new, tau2, o) if tau2 else new
            change, phi = float(np.linalg.norm(new - phi)), new
        rest = eye - b
        a = (rho * rest + 2 * (rest @ phi) @ phi.T) / (rho + 2)
        moved = a - eye
        b = b + moved + o.momentum * moved
        error = eye - (a @ phi) @ phi.T
        rmse = float(np.sqrt(max(0.0, (np.sum(error * (val.gram @ error)) + outside) / max(1, val.n * sites))))
        best = min(best, rmse)
        primal, dual = size(moved), rho * size(a - before)
        eps_primal = o.tolerance + 10 * o.tolerance * max(size(a), size(eye), 1e-12)
        eps_dual = o.tolerance + 10 * o.tolerance * max(np.sqrt(y_square), 1e-12)
        history.append({"round": i + 1, "primal": primal, "dual": dual, "change": change, "rmse": rmse})
        if i + 1 >= o.least_rounds and dual <= eps_dual and change <= eps_primal:
            break
    return BasisFit(phi, best, history)


def trial_grid(spark, tau1: Sequence[float], tau2: Sequence[float], seeds: Sequence[int] = (0,)) -> DataFrame:
    rows = [(s, i, float(a), float(b)) for s in seeds for i, (a, b) in enumerate((a, b) for a in tau1 for b in tau2)]
    return spark.createDataFrame(rows, "seed int, trial int, tau1 double, tau2 double")


def run_trials(trials: DataFrame, by_seed: dict[int, tuple], omega: np.ndarray, k: int, options: FitOptions | None = None) -> DataFrame:
    """Every trial fitted in a task of its own kind: (seed, trial, tau1, tau2, val_rmse, rounds).
    ``by_seed``: (train moments, val moments, y_sd, y_square) for each seed."""
    shared = trials.sparkSession.sparkContext.broadcast((by_seed, omega))

    def one(f: pd.DataFrame) -> pd.DataFrame:
        stats, penalty = shared.value
        rows = []
        for r in f.itertuples():
            train, val, sd, square = stats[r.seed]
            fit = fit_basis(train, val, penalty, k, r.tau1, r.tau2, sd, square, options)
            rows.append((r.seed, r.trial, r.tau1, r.tau2, fit.best_rmse, len(fit.history)))
        return pd.DataFrame(rows, columns=["seed", "trial", "tau1", "tau2", "val_rmse", "rounds"])

    return trials.groupBy("seed", "trial").applyInPandas(one, "seed int, trial int, tau1 double, tau2 double, val_rmse double, rounds int")


def best_trial(trials: DataFrame, value: str = "val_rmse", largest: bool = False) -> DataFrame:
    """For each seed the best trial; the first of equal ones. Missing values are worst."""
    order = F.col(value).desc_nulls_last() if largest else F.col(value).asc_nulls_last()
    return trials.withColumn("_r", F.row_number().over(Window.partitionBy("seed").orderBy(order, "trial"))).where("_r = 1").drop("_r")


# ---------------------------------------------------------------- projection


def scores(panel: DataFrame, phi: DataFrame, value: str = "r") -> DataFrame:
    """(t, k, eta) of residuals (site_id, t, value) on a long basis (site_id, k, phi)."""
    return panel.join(phi, "site_id").groupBy("t", "k").agg(F.sum(F.col(value) * F.col("phi")).alias("eta"))


def _packed(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, ks, vs): the entries of each row of a long table (by, k, value)."""
    own = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("k", value))).alias("c"))
    return own.select(by, F.col("c.k").alias("ks"), F.col(f"c.{value}").alias("vs"))


def _dense(frame: pd.DataFrame, width: int) -> np.ndarray:
    out = np.zeros((len(frame), width))
    for i, (ks, vs) in enumerate(zip(frame["ks"], frame["vs"])):
        out[i, np.asarray(ks, int)] = vs
    return out


def reconstructed(eta: DataFrame, phi: DataFrame, times: int = 1024, sites: int = 512) -> DataFrame:
    """(t, site_id, fitted): the product of long scores (t, k, eta) and a long basis (site_id, k, phi).

    Scores are packed by time and basis rows by site; both are dealt to tasks of a block of times and one of
    sites, each of which is a matrix product. No row has a k of its own on the way."""
    left, right = written(_packed(eta, "t", "eta")), written(_packed(phi, "site_id", "phi"))
    counts = (left.count(), right.count())
    tb, sb = (max(1, -(-n // size)) for n, size in zip(counts, (times, sites)))
    deal = lambda df, key, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"t": [], "site_id": [], "fitted": []})
        width = 1 + int(max(max(max(ks, default=-1) for ks in f["ks"]) for f in (a, b)))
        out = _dense(a, width) @ _dense(b, width).T
        return pd.DataFrame({"t": np.repeat(a["t"].to_numpy(), len(b)), "site_id": np.tile(b["site_id"].to_numpy(), len(a)), "fitted": out.ravel()})

    own, other = deal(left, "t", "tb", tb, "sb", sb), deal(right, "site_id", "sb", sb, "tb", tb)
    return own.groupBy("tb", "sb").cogroup(other.groupBy("tb", "sb")).applyInPandas(one, "t long, site_id long, fitted double")


def projected(panel: DataFrame, phi: DataFrame, value: str = "r") -> DataFrame:
    """The panel with ``fitted``, the projection of its own rows: for evaluation, as it uses the
    true values of the rows that it is compared with. Each row meets its time's scores and its site's
    basis row, and their inner product is its value; null at sites without a basis row."""
    eta, rows = _packed(scores(panel, phi, value), "t", "eta"), _packed(phi, "site_id", "phi")
    width = rows.agg(F.max(F.array_max("ks"))).first()[0]
    full = lambda df, key, name: df.select(key, F.transform(F.sequence(F.lit(0), F.lit(int(width or 0))), lambda k: F.coalesce(F.element_at(F.map_from_arrays("ks", "vs"), k.cast("long")), F.lit(0.0))).alias(name))
    out = panel.join(full(eta, "t", "_eta"), "t", "left").join(full(rows, "site_id", "_phi"), "site_id", "left")
    fitted = F.aggregate(F.zip_with("_eta", "_phi", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("fitted", fitted).drop("_eta", "_phi")


def off_basis(panel: DataFrame, phi: DataFrame, value: str = "r") -> DataFrame:
    rows = projected(panel, phi, value)
    d = F.col(value) - F.col("fitted")
    return rows.agg(F.max(F.abs(d)).alias("largest"), (F.sqrt(F.sum(d * d)) / F.sqrt(F.sum(F.col(value) * F.col(value)))).alias("share"))


def fit_diagnostics(m: Moments, phi: np.ndarray, omega: np.ndarray, tau1: float, tau2: float) -> dict[str, float]:
    n, k = phi.shape
    error = np.eye(n) - phi @ phi.T
    recon = float(np.sum(error * (m.gram @ error))) / max(1, m.n * n)
    return diagnostics_of(recon, tau1 * float(np.sum(phi * (omega @ phi))), tau2 * float(np.abs(phi).sum()), n, k)


def diagnostics_of(recon: float, smooth: float, l1: float, n: int, k: int) -> dict[str, float]:
    held = max(recon, 1e-12)
    return {
        "recon_mse": recon, "smooth_penalty": smooth, "l1_penalty": l1, "total": recon + smooth + l1, "n_locations": n, "k_basis": k,
        "smooth_per_entry": smooth / (n * k), "l1_per_entry": l1 / (n * k), "smooth_over_recon": smooth / (n * k) / held, "l1_over_recon": l1 / (n * k) / held,
    }


# ---------------------------------------------------------------- kriging


def conditional(panel: DataFrame, phi: DataFrame, eigenvalues: np.ndarray, noise: float, value: str = "r", block: int = 4096) -> DataFrame:
    """(t, eta, cov) given what a panel (t, site_id, value) shows at each time, on a long basis; nothing seen
    (no finite value, or none at a site of the basis): the prior.

    The covariance depends on the sites that are seen only, so it is solved once for each such pattern, which
    128 bits of hashes stand for, at one of its times. Sites meet in blocks, each of which leaves a k x k
    or a k sum, so neither sites nor times are bounded."""
    parts, times = _seen(panel, phi, value, block)
    k, lam = len(eigenvalues), np.asarray(eigenvalues, float)

    def inner(f: pd.DataFrame) -> pd.DataFrame:
        b = np.stack(f["b"].to_numpy())
        return pd.DataFrame({"t": f["t"].iloc[:1], "x": [(b.T @ b).tobytes()]})

    def solved(f: pd.DataFrame) -> pd.DataFrame:
        cov = np.linalg.inv(np.diag(1 / (lam + 1e-12)) + sum(np.frombuffer(x) for x in f["x"]).reshape(k, k) / noise + 1e-12 * np.eye(k))
        return pd.DataFrame({"rep": f["t"].iloc[:1], "cov": [[list(x) for x in cov]]})

    def side(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"t": f["t"].iloc[:1], "k": [list(range(k))], "x": [np.stack(f["b"].to_numpy()).T @ f["v"].to_numpy(float)]})

    patterns = patterns_of(times)
    one = parts.join(patterns.select(F.col("rep").alias("t")), "t", "left_semi")
    covariances = one.groupBy("t", "block").applyInPandas(inner, "t long, x binary").groupBy("t").applyInPandas(solved, "rep long, cov array<array<double>>")
    sums = parts.groupBy("t", "block").applyInPandas(side, "t long, k array<int>, x array<double>")
    sums = sums.groupBy("t").agg(F.array(*[F.sum(F.col("x")[i]) for i in range(k)]).alias("side"))
    known = times.join(patterns, ["p", "q", "n"]).join(covariances, "rep").join(sums, "t")
    zero, none = F.lit(0.0), times.where("n = 0")
    inner_product = lambda row: F.aggregate(F.zip_with(row, "side", lambda a, b: a * b), zero, lambda a, x: a + x)
    prior = F.array(*[F.array(*[F.lit(float(lam[i]) if i == j else 0.0) for j in range(k)]) for i in range(k)])
    seen = known.select("t", F.transform("cov", lambda row: inner_product(row) / noise).alias("eta"), "cov")
    return seen.unionByName(none.select("t", F.array(*[zero] * k).alias("eta"), prior.alias("cov")))


def _seen(panel: DataFrame, phi: DataFrame, value: str, block: int) -> tuple[DataFrame, DataFrame]:
    """(t, site_id, v, b, block) of what is seen at sites of the basis, and (t, n, p, q) for every time: how many
    sites those are, and two hashes of which ones."""
    rows = phi.groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct("k", "phi"))).alias("c")).select("site_id", F.col("c.phi").alias("b"))
    blocks = max(1, -(-rows.count() // block))
    cells = panel.groupBy("t", "site_id").agg(F.avg(value).alias("v")).join(rows, "site_id", "left")
    own = F.col("b").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
    cells = written(cells.withColumns({"own": own, "block": F.pmod(F.xxhash64("site_id"), F.lit(blocks))}))
    mark = lambda salt: F.coalesce(F.bit_xor(F.when(F.col("own"), F.xxhash64(F.lit(salt), "site_id"))), F.lit(0).cast("long"))
    times = written(cells.groupBy("t").agg(F.count_if("own").alias("n"), mark(1).alias("p"), mark(2).alias("q")))
    return cells.where("own"), times


def patterns_of(times: DataFrame) -> DataFrame:
    """(p, q, n, rep): each pattern of seen sites, and the first time that has it."""
    return times.where("n > 0").groupBy("p", "q", "n").agg(F.min("t").alias("rep"))


def predicted_at(rows: DataFrame, conditionals: DataFrame, basis: DataFrame, noise: float) -> DataFrame:
    """``rows`` (t, site_id, ...) with their ``mean`` and ``var``, from ``conditional``'s rows and the basis rows (site_id,
    phi array) of the sites: each row meets its time and its site, so only what is asked for is computed."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    out = rows.join(conditionals.select("t", F.col("eta").alias("_eta"), F.col("cov").alias("_cov")), "t").join(basis.select("site_id", F.col("phi").alias("_phi")), "site_id")
    spread = dot(F.transform("_cov", lambda row: dot(row, F.col("_phi"))), F.col("_phi"))
    return out.withColumns({"mean": dot(F.col("_eta"), F.col("_phi")), "var": spread + noise}).drop("_eta", "_cov", "_phi")


def kriging_at(panel: DataFrame, phi: DataFrame, fit: LowRank, new_basis: DataFrame, value: str = "r") -> tuple[DataFrame, DataFrame]:
    """Means (t, site_id, mean) for all times of a complete panel, and (site_id, var), at the sites of
    ``new_basis`` (site_id, phi array). Only K x K matrices are solved here; neither sites nor times are
    collected: scores are one aggregate, and means are their product with the new sites' basis rows."""
    lam, g = np.diag(fit.eigenvalues), fit.rotation.T @ fit.inner @ fit.rotation
    x = np.linalg.lstsq(fit.noise * np.eye(len(lam)) + lam @ g, lam, rcond=None)[0]
    weights, inner = fit.rotation @ x @ fit.rotation.T, fit.rotation @ (lam - lam @ g @ x) @ fit.rotation.T
    k = len(lam)
    turned = rotated(scores(panel, phi, value).select(F.col("t").alias("site_id"), "k", F.col("eta").alias("phi")), weights)
    turned = turned.select(F.col("site_id").alias("t"), "k", F.col("phi").alias("eta"))
    long = new_basis.select("site_id", F.posexplode("phi").alias("k", "phi"))
    mean = reconstructed(turned, long).withColumnRenamed("fitted", "mean")
    square = sum((float(inner[i, j]) * F.col("phi")[i] * F.col("phi")[j] for i in range(k) for j in range(k)), F.lit(float(fit.noise)))
    return mean, new_basis.select("site_id", F.greatest(square, F.lit(0.0)).alias("var"))


# ---------------------------------------------------------------- forecasts


@dataclass
class Forecaster:
    matrix: np.ndarray
    last: np.ndarray

    def states(self, steps: int) -> list[np.ndarray]:
        out, eta = [], self.last
        for _ in range(steps):
            eta = self.matrix @ eta
            out.append(eta)
        return out


def fit_forecaster(eta: DataFrame, ridge: float = 1e-4) -> Forecaster:
    """First-order vector autoregression of scores (t, k, eta). Times are numbered in order (one number for
    each), and each meets the one before by a join on that; products are added up in tasks."""
    rows = eta.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("k", "eta"))).alias("c")).select("t", F.col("c.eta").alias("eta"))
    placed = written(rows.join(index_of(rows, ["t"], "place"), "t").select("place", "eta"))
    pairs = placed.join(placed.select((F.col("place") + 1).alias("place"), F.col("eta").alias("before")), "place")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xx = xy = None
        for f in frames:
            if len(f):
                x, y = np.stack(f["before"].to_numpy()), np.stack(f["eta"].to_numpy())
                xx, xy = (x.T @ x, x.T @ y) if xx is None else (xx + x.T @ x, xy + x.T @ y)
        if xx is not None:
            yield pd.DataFrame({"xx": [xx.tobytes()], "xy": [xy.tobytes()]})

    last = np.array(rows.agg(F.max_by("eta", "t")).first()[0] or [], float)
    k = len(last)
    parts = pairs.mapInPandas(run, "xx binary, xy binary").collect()
    add = lambda c: sum((np.frombuffer(r[c]).reshape(k, k) for r in parts), np.zeros((k, k)))
    return Forecaster(np.linalg.solve(add("xx") + ridge * np.eye(k), add("xy")).T, last)


def save_forecaster(spark, path: str, model: Forecaster, version: int = 0, steps: int = 0) -> None:
    """One row of a model table: version, matrix, last state, and by how many steps it came from the version before."""
    row = [(version, [list(map(float, x)) for x in model.matrix], list(map(float, model.last)), steps)]
    spark.createDataFrame(row, "version long, matrix array<array<double>>, last array<double>, steps int").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version:012d}")


def model_versions(spark, path: str) -> DataFrame:
    return spark.read.schema("version long, matrix array<array<double>>, last array<double>, steps int").option("recursiveFileLookup", True).parquet(path)


def load_forecaster(spark, path: str, version: int | None = None) -> tuple[int, Forecaster]:
    """The newest version, or the one that is named."""
    rows = model_versions(spark, path)
    row = (rows if version is None else rows.where(F.col("version") == version)).orderBy(F.col("version").desc()).first()
    if row is None:
        raise ValueError("there is no such version of the model")
    return row.version, Forecaster(np.array(row.matrix), np.array(row["last"]))


def claimed(spark, path: str) -> bool:
    """Whether this call made the file ``path``; of several calls, one does."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(place)


def carried_forecast(path: str, phi: DataFrame, mu: DataFrame, version: int | None = None, take_over: bool = False) -> tuple[DataFrame, int]:
    """The forecast of the model table at ``path``, and the version that holds the state it ends with, from which the
    next call goes on. ``version``: the state to start from, the newest one if it is not named.

    The next version is claimed by making a file that is not there yet, so of two calls from one state one writes
    it. A call from a version that has been gone on from is a rerun: the same rows, and nothing is written; it
    is an error if it asks for another number of steps. So is a version that is claimed and not written;
    ``take_over`` writes it in place of a call that was lost."""
    spark = mu.sparkSession
    at, model = load_forecaster(spark, path, version)
    steps = mu.agg(F.max("h")).first()[0] or 0
    if claimed(spark, f"{path}/_claim-{at + 1:012d}") or take_over:
        states = model.states(steps)
        save_forecaster(spark, path, Forecaster(model.matrix, states[-1] if states else model.last), at + 1, steps)
    row = model_versions(spark, path).where(F.col("version") == at + 1).select("steps").first()
    if row is None or row.steps != steps:
        raise ValueError(f"version {at + 1} is claimed by a call that is not done" if row is None else f"version {at + 1} is {row.steps} steps on, not {steps}")
    return forecast(model, phi, mu), at + 1


def forecast(model: Forecaster | None, phi: DataFrame, mu: DataFrame) -> DataFrame:
    """(h, site_id, value) for the horizon table ``mu`` (h from 1, site_id, mu); without a model,
    the trend alone. ``carried_forecast`` keeps the state between calls."""
    if model is None:
        return mu.select("h", "site_id", F.col("mu").alias("value"))
    steps = mu.agg(F.max("h")).first()[0] or 0
    rows = [(h + 1, k, float(v)) for h, eta in enumerate(model.states(steps)) for k, v in enumerate(eta)]
    eta = mu.sparkSession.createDataFrame(rows, "t long, k long, eta double")
    added = reconstructed(eta, phi).select(F.col("t").alias("h"), "site_id", F.col("fitted").alias("s"))
    return mu.join(added, ["h", "site_id"], "left").select("h", "site_id", (F.col("mu") + F.coalesce("s", F.lit(0.0))).alias("value"))


# ---------------------------------------------------------------- features and scoring

#: Fixed factors that bring the three kernels to the same spread.
CALIBRATION = {"wendland": 1.0, "gaussian": 0.223477, "triangular": 0.654714}


def radial(r: Column, kind: str) -> Column:
    if kind == "gaussian":
        return F.exp(-0.5 * r * r)
    near = F.greatest(1 - r, F.lit(0.0))
    if kind == "triangular":
        return near
    if kind == "wendland":
        held = F.least(r, F.lit(1.0))
        return F.pow(near, F.lit(6.0)) * (35 * held * held + 18 * held + 3) / 3
    raise ValueError("kind is 'wendland', 'gaussian' or 'triangular'")


def uniform_centres(spark, counts: Sequence[int] = (25, 81, 121)) -> DataFrame:
    """(level, id, x, y, bandwidth) on square grids over [0, 1]^2; bandwidth: 2.5 spacings."""
    rows = None
    for level, n in enumerate(counts):
        side = round(n**0.5)
        if side * side != n:
            raise ValueError("counts are perfect squares")
        gap = 1 / (side - 1) if side > 1 else 1.0
        part = spark.range(n).select(F.lit(level).alias("level"), "id", (F.floor(F.col("id") / side) * F.lit(gap)).alias("x"), ((F.col("id") % side) * F.lit(gap)).alias("y"), F.lit(2.5 * gap).alias("bandwidth"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def spatial_features(points: DataFrame, centres: DataFrame, kind: str = "wendland") -> DataFrame:
    """``points`` with ``features``, one for each centre in their order. Centres are a few hundred
    by construction; they travel as one array column."""
    packed = centres.agg(F.sort_array(F.collect_list(F.struct("level", "id", "x", "y", "bandwidth"))).alias("_centres"))
    r = lambda c: F.sqrt((F.col("x") - c["x"]) * (F.col("x") - c["x"]) + (F.col("y") - c["y"]) * (F.col("y") - c["y"])) / (c["bandwidth"] * CALIBRATION[kind])
    return points.join(packed).withColumn("features", F.transform("_centres", lambda c: radial(r(c), kind))).drop("_centres")


def temporal_features(t: Column, counts: Sequence[int] = (10, 15, 45), factor: float = 2.5) -> Column:
    """array<double>: Gaussian bumps over [0, 1]."""
    def bumps(n: int) -> Column:
        gap = 1 / (n - 1) if n > 1 else 1.0
        scaled = lambda i: (t - i * gap) / (factor * gap)
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.exp(-0.5 * scaled(i) * scaled(i)))

    return F.concat(*[bumps(n) for n in counts])


def drawn_centres(points: DataFrame, counts: Sequence[int], seed: int, key: str = "point_id") -> DataFrame:
    """(level, id, x, y, bandwidth): observations in a seeded order, so that denser places give more
    centres; bandwidth: 2.5 times the mean distance to the 4 nearest of the same level."""
    from tessella.operators.spatial import neighbour_distance

    rows = None
    for level, n in enumerate(counts):
        order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(level)), F.col(key).cast("string")).cast("binary"))
        drawn = points.orderBy(order, key).limit(n).select(F.col(key).alias("site_id"), "x", "y")
        near = neighbour_distance(drawn).select("site_id", (2.5 * F.col("distance")).alias("bandwidth"))
        part = drawn.join(near, "site_id", "left").select(F.lit(level).alias("level"), F.col("site_id").alias("id"), "x", "y", F.coalesce("bandwidth", F.lit(2.5)).alias("bandwidth"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def scored(df: DataFrame, features: Sequence[str], load: Callable[[], Callable[[np.ndarray], np.ndarray]], name: str = "y_pred") -> DataFrame:
    """A frozen model over rows: ``load`` is called once in each task and gives a function from a
    feature matrix to predictions."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            f[name] = model(f[list(features)].to_numpy(float)) if len(f) else pd.Series([], dtype=float)
            yield f

    return df.mapInPandas(run, schema)


def binary_residual(y: Column, mu: Column) -> Column:
    return logit(y) - mu
