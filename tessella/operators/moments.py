"""Second moments of panels, and what is solved from them.

A panel is reduced to n, the column sums and the Gram matrix R'R in one pass: rows are packed by
time, each task adds up its own matrix in stripes of sites, and the stripes of all tasks are added
in two steps. Only the finished N x N matrix comes to the driver, where N is checked."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.storage import written
from tessella.operators.blocks import pair_sums, square_sum
from tessella.operators.panel import index_of

#: A matrix of all sites is held by one task (and, for fits, comes to the driver) up to so many: 32 MB.
MOST_SITES = 2048
STRIPE = 256


@dataclass
class Moments:
    """Of complete rows: their number, column sums and Gram matrix; ``sites`` gives the order."""

    n: int
    total: np.ndarray
    gram: np.ndarray
    sites: list

    @property
    def mean(self) -> np.ndarray:
        return self.total / max(1, self.n)

    @property
    def centred(self) -> np.ndarray:
        return self.gram - self.n * np.outer(self.mean, self.mean)

    def covariance(self) -> np.ndarray:
        if self.n < 2:
            raise ValueError("a covariance needs two rows")
        c = self.centred / (self.n - 1)
        return (c + c.T) / 2


def complete_rows(panel: DataFrame, sites: DataFrame, value: str, n: int) -> DataFrame:
    """(t, vals) for the times at which every site has a value."""
    cells = panel.join(sites, "site_id").groupBy("t", "i").agg(F.avg(value).alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    rows = cells.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("c"))
    return rows.where(F.size("c") == n).select("t", F.col("c.v").alias("vals"))


def moments(panel: DataFrame, value: str = "z", where=None) -> Moments:
    own = panel.where(where) if where is not None else panel
    sites = index_of(panel, ["site_id"], "i")
    names = [r.site_id for r in sites.orderBy("i").limit(MOST_SITES + 1).collect()]
    n = len(names)
    if n > MOST_SITES:
        raise ValueError(f"dense moments are for {MOST_SITES} sites at most")
    rows = complete_rows(own, sites, value, n).select("vals")

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, total, count = np.zeros((n, n)), np.zeros(n), 0
        for f in frames:
            if len(f):
                x = np.stack(f["vals"].to_numpy())
                gram, total, count = gram + x.T @ x, total + x.sum(0), count + len(x)
        if count:
            for s in range(0, n, STRIPE):
                yield pd.DataFrame({"stripe": [s], "salt": [int(abs(total[0]) * 1e6) % 16], "n": [count], "sums": [total[s : s + STRIPE].tobytes()], "block": [gram[s : s + STRIPE].tobytes()]})

    def added(f: pd.DataFrame) -> pd.DataFrame:
        add = lambda c: sum(np.frombuffer(b) for b in f[c]).tobytes()
        return pd.DataFrame({"stripe": [f["stripe"].iloc[0]], "salt": [0], "n": [f["n"].sum()], "sums": [add("sums")], "block": [add("block")]})

    schema = "stripe int, salt int, n long, sums binary, block binary"
    stripes = rows.mapInPandas(partial, schema).groupBy("stripe", "salt").applyInPandas(added, schema).groupBy("stripe").applyInPandas(added, schema)
    found = sorted(stripes.collect(), key=lambda r: r.stripe)
    if not found:
        return Moments(0, np.zeros(n), np.zeros((n, n)), names)
    return Moments(found[0].n, np.concatenate([np.frombuffer(r.sums) for r in found]), np.concatenate([np.frombuffer(r.block).reshape(-1, n) for r in found]), names)


# ---------------------------------------------------------------- long forms


def gram_long(panel: DataFrame, value: str = "z") -> DataFrame:
    """(i, j, v, n): sums of products over the times that both sites have."""
    return pair_sums(panel, value).select("i", "j", "v", "n")


def covariance_long(panel: DataFrame, value: str = "z", least: int = 2) -> DataFrame:
    """(i, j, v): sample covariance over common times; null for fewer than ``least`` of them. Values are
    taken less their mean over all, which changes no covariance and keeps the sums small."""
    level = panel.agg(F.avg(value).alias("_level"))
    sums = pair_sums(panel.join(level).withColumn("_v", F.col(value) - F.col("_level")), "_v")
    return sums.select("i", "j", F.when(F.col("n") >= least, (F.col("v") - F.col("a") * F.col("b") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))).alias("v"))


def frobenius_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two matrices (i, j, v) in coordinate form; missing entries are 0."""
    both = a.select("i", "j", F.col("v").alias("a")).join(b.select("i", "j", F.col("v").alias("b")), ["i", "j"], "full")
    d = F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))
    return both.agg(F.coalesce(F.sqrt(F.sum(d * d)), F.lit(0.0)).alias("distance"))


# ---------------------------------------------------------------- spectra and low-rank fits


def spectrum(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors, largest first; the largest entry of each vector is positive."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(signs == 0, 1, signs)


@dataclass
class LowRank:
    eigenvalues: np.ndarray
    rotation: np.ndarray
    noise: float
    rank: int
    #: phi'phi, and phi where it came as a matrix.
    inner: np.ndarray
    phi: np.ndarray | None = None

    def matrix(self) -> np.ndarray:
        b = self.phi @ self.rotation
        return (b * self.eigenvalues) @ b.T + self.noise * np.eye(len(b))

    def variance(self) -> np.ndarray:
        b = self.phi @ self.rotation
        return (b * b) @ self.eigenvalues + self.noise


@dataclass
class BasisMoments:
    """What complete rows leave on a basis phi (sites x k): their number, the sites, the trace of R'R / n, the
    second moments of the scores R phi, and phi'phi. Only k x k matrices, so there is no bound on sites."""

    n: int
    sites: int
    trace: float
    second: np.ndarray
    inner: np.ndarray
    phi: np.ndarray | None = None

    @staticmethod
    def of(m: Moments, phi: np.ndarray) -> BasisMoments:
        if not m.n or len(phi) != len(m.gram):
            raise ValueError("basis and moments must be non-empty and of the same sites")
        s = m.gram / m.n
        return BasisMoments(m.n, len(phi), float(np.trace(s)), phi.T @ s @ phi, phi.T @ phi, phi)


def crossed(rows: DataFrame, by: str, value: str) -> np.ndarray:
    """The k x k sums of products of long rows (by, k, value) that share ``by``."""
    pairs = rows.select(by, F.col("k").alias("i"), F.col(value).alias("a")).join(rows.select(by, F.col("k").alias("j"), F.col(value).alias("b")), by)
    found = pairs.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v")).collect()
    k = 1 + max((r.i for r in found), default=-1)
    out = np.zeros((k, k))
    for r in found:
        out[r.i, r.j] = r.v
    return out


def complete_cells(panel: DataFrame, value: str, where=None) -> tuple[DataFrame, DataFrame, int]:
    """(t, site_id, v) and (t, squares) of the times with ``where`` at which every site of the panel has a value,
    and the number of sites."""
    n = panel.select("site_id").distinct().count()
    own = panel.where(where) if where is not None else panel
    cells = written(own.groupBy("t", "site_id").agg(F.avg(value).alias("v")).where("v IS NOT NULL AND NOT isnan(v)"))
    times = cells.groupBy("t").agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("v")).alias("squares")).where(F.col("n") == n).drop("n")
    return cells.join(times.select("t"), "t", "left_semi"), times, n


def gram_sums(panel: DataFrame, value: str, where=None) -> DataFrame:
    """(site_id, own, row): the diagonal and the row sums of R'R over complete rows, without the matrix: a row of it
    adds up to the site's values times the sums of all sites at their times."""
    cells, times, _ = complete_cells(panel, value, where)
    total = cells.groupBy("t").agg(F.sum("v").alias("s"))
    return cells.join(total, "t").groupBy("site_id").agg(F.sum(F.col("v") * F.col("v")).alias("own"), F.sum(F.col("v") * F.col("s")).alias("row"))


def basis_moments(panel: DataFrame, phi: DataFrame, value: str = "r", where=None) -> BasisMoments:
    """Of a panel on a long basis (site_id, k, phi), by aggregates: scores are added up before they are paired."""
    cells, times, n = complete_cells(panel, value, where)
    row = times.agg(F.count("*").alias("n"), F.sum("squares").alias("squares")).first()
    if not row.n:
        raise ValueError("there is no complete row")
    eta = written(cells.join(phi, "site_id").groupBy("t", "k").agg(F.sum(F.col("v") * F.col("phi")).alias("eta")))
    own = phi.join(panel.select("site_id").distinct(), "site_id", "left_semi")
    return BasisMoments(row.n, n, row.squares / row.n, crossed(eta, "t", "eta") / row.n, crossed(own, "site_id", "phi"))


def low_rank(m: Moments | BasisMoments, phi: np.ndarray | None = None) -> LowRank:
    """Projected spectrum of the uncentred covariance; the rank is the largest L whose eigenvalue is
    above the mean variance left beyond it, and the kept eigenvalues are shrunk by that noise. No
    such L: no component, all variance is noise."""
    own = m if isinstance(m, BasisMoments) else BasisMoments.of(m, phi)
    p, k = own.sites, len(own.second)
    values, rotation = spectrum(own.second)
    left = np.array([max(0.0, (own.trace - values[: i + 1].sum()) / (p - i - 1)) if p > i + 1 else np.inf for i in range(k)])
    above = np.flatnonzero(values > left)
    rank = int(above[-1]) + 1 if len(above) else 0
    noise = float(left[rank - 1]) if rank else own.trace / p
    kept = np.where(np.arange(k) < rank, np.maximum(values - noise, 0), 0.0)
    return LowRank(kept, rotation, noise, rank, own.inner, own.phi)


def plug_in(m: Moments | BasisMoments, phi: np.ndarray | None = None, rotate: bool = False) -> LowRank:
    """Noise from the variance outside the basis, 1e-6 at least; eigenvalues less the noise. With
    ``rotate=False`` they go to the basis columns in order."""
    own = m if isinstance(m, BasisMoments) else BasisMoments.of(m, phi)
    k = len(own.second)
    values, rotation = spectrum(own.second)
    noise = max(1e-6, (own.trace - float(values.sum())) / max(1, own.sites - k))
    kept = np.maximum(values - noise, 0)
    return LowRank(kept, rotation if rotate else np.eye(k), noise, int((kept > 0).sum()), own.inner, own.phi)


def model_row(spark, fit: LowRank) -> DataFrame:
    return spark.createDataFrame([(fit.eigenvalues.tolist(), fit.rotation.tolist(), fit.noise, fit.rank)], "eigenvalues array<double>, rotation array<array<double>>, noise_var double, effective_rank int")


def spectrum_errors(truth: DataFrame, estimate: DataFrame, k: int) -> DataFrame:
    """Mean relative and absolute errors of the first k eigenvalues."""
    both = truth.where(F.col("component") <= k).select("component", F.col("eigenvalue").alias("a")).join(estimate.select("component", F.col("eigenvalue").alias("b")), "component")
    return both.agg(F.avg(F.abs(F.col("a") - F.col("b")) / (F.abs("a") + 1e-12)).alias("relative"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("absolute"))


def alignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """(k, best, cosine): for each column of basis ``a`` (site_id, k, phi), the column of ``b`` with
    the largest absolute cosine."""
    both = a.join(b.select("site_id", F.col("k").alias("other"), F.col("phi").alias("p")), "site_id")
    dots = both.groupBy("k", "other").agg((F.sum(F.col("phi") * F.col("p")) / (F.sqrt(F.sum(F.col("phi") * F.col("phi"))) * F.sqrt(F.sum(F.col("p") * F.col("p"))))).alias("c"))
    return dots.groupBy("k").agg(F.max_by("other", F.struct(F.abs(F.col("c")), -F.col("other"))).alias("best"), F.max(F.abs(F.col("c"))).alias("cosine"))


def residual_moments(panel: DataFrame, phi: DataFrame | None = None, value: str = "r") -> DataFrame:
    """(trace, norm, basis_norm): trace and Frobenius norm of R'R / n over complete rows, and the norm of a long
    basis (0 without one), by aggregates over pairs of sites, or of times where these are fewer, in blocks."""
    cells, times, count = complete_cells(panel, value)
    n = times.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), F.coalesce(F.sum("squares"), F.lit(0.0)).alias("trace"))
    # R'R and RR' have the same norm; the smaller of the two is formed.
    turned = times.count() < count
    norm = square_sum(cells.select(F.col("t").alias("site_id"), F.col("site_id").alias("t"), "v") if turned else cells)
    basis = F.lit(0.0) if phi is None else F.col("basis_norm")
    out = n.join(norm) if phi is None else n.join(norm).join(phi.agg(F.sqrt(F.coalesce(F.sum(F.col("phi") * F.col("phi")), F.lit(0.0))).alias("basis_norm")))
    return out.select((F.col("trace") / F.col("n")).alias("trace"), (F.col("norm") / F.col("n")).alias("norm"), basis.alias("basis_norm"))
