"""The regularised basis fit for any number of sites: ``models.fit_basis`` with its states in factored form.

With all bases so far side by side in P (sites x r), the consensus and dual maps are c I + P X P' with a small
X: each round only changes c and X, and its norms are traces of small products, of P with itself and of R'R P
with P. Only the update of the basis touches tall tables: products of the panel's tiles and of the splines'
tiles with columns, inside of the rounds of ``spectra.leading``. With few train times and no second penalty, all bases
lie in the space of the train rows and what the smoothing matrix makes of them again and again; there the whole fit is
one of small matrices. So the driver holds r x r numbers (r is k times
the number of updates), and no sites x sites matrix but the splines' tiles exists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.storage import written
from tessella.functions.tasks import in_task
from tessella.operators import spectra, splines
from tessella.operators.models import BasisFit, FitOptions, diagnostics_of, fit_basis, projected
from tessella.operators.moments import Moments

#: Columns of a subspace at most, and train times for which one is tried; its fit is taken when one more product with the
#: smoothing matrix moves no basis column by more than ``SETTLED``.
MOST_COLUMNS, MOST_TIMES, SETTLED = 1024, 64, 1e-7


@dataclass
class TallFit:
    """``columns`` (sb, n, x) of the basis in blocks of ``sites``; the other fields as in ``models.BasisFit``."""

    columns: DataFrame
    sites: DataFrame
    best_rmse: float
    history: list[dict] = field(default_factory=list)

    def long(self) -> DataFrame:
        k = splines.width(self.columns)
        return spectra.Leading(np.zeros(k), self.columns, self.sites, 0.0, 0).long(signed=False)


@dataclass
class Map:
    """c I + P x P'."""

    c: float
    x: np.ndarray

    def grown(self, k: int) -> Map:
        return Map(self.c, np.pad(self.x, (0, k)))

    def plus(self, other: Map, factor: float = 1.0) -> Map:
        return Map(self.c + factor * other.c, self.x + factor * other.x)

    def square(self, trace: float, form: np.ndarray, inner: np.ndarray) -> float:
        """tr(M' S M) for S with this trace and P'SP = form; inner: P'P."""
        return self.c**2 * trace + 2 * self.c * np.trace(self.x @ form) + np.trace(self.x.T @ form @ self.x @ inner)


class Problem:
    """Tiles of the residuals at train times (as they are, and centred) and at val times, splines, and all bases so far."""

    def __init__(self, train: DataFrame, val: DataFrame, sites: DataFrame, value: str, block: int) -> None:
        self.train, self.centred, self.val = spectra.tiled(train, value, sites=block), spectra.tiled(train, value, centred=True, sites=block), spectra.tiled(val, value, sites=block)
        self.splines = splines.splines(sites.join(train.select("site_id").distinct(), "site_id", "left_semi"), block=block)
        self.n = self.train.sites.agg(F.sum("n")).first()[0]
        self.bases: DataFrame | None = None
        self.inner = self.of_train = self.of_val = self.of_centred = np.zeros((0, 0))

    def times(self, tiles: spectra.Tiles, columns: DataFrame) -> DataFrame:
        return written(spectra.product(tiles, columns).join(columns.select("sb", "n"), "sb").select("sb", "n", "x"))

    def add(self, phi: DataFrame) -> None:
        """Another basis at the right of P; tables and small products grow by its columns."""
        new = [phi, *(self.times(t, phi) for t in (self.train, self.val, self.centred))]
        old = self.bases
        r, k = len(self.inner), splines.width(phi)
        # P, then the three products with P, as four groups of columns.
        wide = spectra.beside(new) if old is None else spectra.beside([old, *new])
        place = lambda g: [*(range(g * r, (g + 1) * r) if r else []), *range(4 * r + g * k, 4 * r + (g + 1) * k)]
        order = np.eye(4 * (r + k))[:, [c for g in range(4) for c in place(g)]]
        self.bases = written(spectra.combined(wide, order))
        g, m = spectra.crossed(self.bases), r + k
        self.inner, self.of_train, self.of_val, self.of_centred = (g[:m, i * m : (i + 1) * m] for i in range(4))

    def p(self) -> DataFrame:
        m = len(self.inner)
        return spectra.combined(self.bases, np.eye(4 * m)[:, :m])

    def mapped(self, a: Map, columns: DataFrame, turned: bool = False) -> DataFrame:
        """The map (or its transpose) times columns."""
        m, k = len(self.inner), splines.width(columns)
        if not m:
            return columns
        x = a.x.T if turned else a.x
        cross = spectra.crossed(spectra.beside([self.p(), columns]))[:m, m:]
        return written(spectra.combined(spectra.beside([columns, self.p()]), np.vstack([a.c * np.eye(k), x @ cross])))

    def target(self, a: Map, tau1: float, ridge: float):
        """Columns times a' (R'R centred) a - tau1 times the smoothing matrix, and ridge."""

        def multiply(columns: DataFrame) -> DataFrame:
            k = splines.width(columns)
            y = self.mapped(a, self.times(self.centred, self.mapped(a, columns)), turned=True)
            rough = splines.smoothed(self.splines, columns)
            return spectra.combined(spectra.beside([y, rough, columns]), np.vstack([np.eye(k), -tau1 * np.eye(k), ridge * np.eye(k)])).select("sb", "x")

        return multiply

    def target_trace(self, a: Map, tau1: float, rough: float) -> float:
        own = a.square(self.centred.trace, self.of_centred, self.inner) if len(self.inner) else a.c**2 * self.centred.trace
        return own - tau1 * rough


def _retracted(columns: DataFrame) -> DataFrame:
    values, turn = np.linalg.eigh(spectra.crossed(columns))
    return written(spectra.combined(columns, (turn / np.sqrt(np.maximum(values, 1e-300))) @ turn.T))


def _change(a: DataFrame, b: DataFrame) -> float:
    k = splines.width(a)
    g = spectra.crossed(spectra.beside([a, b]))
    return float(np.sqrt(max(0.0, np.trace(g[:k, :k]) + np.trace(g[k:, k:]) - 2 * np.trace(g[:k, k:]))))


def _sparse(sites: DataFrame, multiply, norm: float, phi: DataFrame, tau2: float, o: FitOptions) -> DataFrame:
    """As ``models._sparse``, with the target known by its products."""
    step, k = 1 / (2 * norm), splines.width(phi)

    def cut(x: np.ndarray) -> np.ndarray:
        own, moved = x[:, :k], x[:, :k] + 2 * step * x[:, k:]
        return np.sign(moved) * np.maximum(np.abs(moved) - step * tau2 / (np.abs(own) + o.sparse_eps), 0)

    for t in range(o.sparse_rounds):
        new = _retracted(written(spectra.applied(spectra.beside([phi, multiply(phi).select("sb", "x")]), cut)))
        change, phi = _change(new, phi), new
        if t >= 2 and change < o.sparse_tolerance:
            break
    return phi


def _as_columns(own: spectra.Tiles) -> DataFrame:
    """The rows of a panel of one span of times as columns (sb, n, x)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                yield pd.DataFrame({"sb": [r.sb], "n": [r.n], "x": [np.ascontiguousarray(np.frombuffer(r.tile).reshape(-1, r.n).T).tobytes()]})

    return written(own.tiles.join(own.sites.select("sb", "n"), "sb").mapInPandas(run, "sb int, n int, x binary"))


def _whitened(g: np.ndarray) -> np.ndarray:
    """What makes columns with these inner products orthonormal; those that others explain are dropped."""
    size, turn = np.linalg.eigh((g + g.T) / 2)
    own = size > 1e-12 * max(size[-1], 1e-300)
    return turn[:, own] / np.sqrt(size[own])


def _fit_in_space(rows: np.ndarray, val: np.ndarray, outside: float, omega: np.ndarray, sites: int, *args) -> BasisFit:
    moments = [Moments(len(x), x.sum(0), x.T @ x, []) for x in (rows, val)]
    return fit_basis(*moments, omega, *args, sites=sites, outside=outside)


def _fit_in_subspace(own: Problem, k: int, tau1: float, y_sd: float, y_square: float, o: FitOptions) -> TallFit | None:
    """The fit without second penalty in the span of R', S R', S S R', ... with S the smoothing matrix, which holds every
    basis: an eigenvector of C C' - tau1 S is (l + tau1 S)^-1 C y, and C is in the span of R' and the bases before.
    Products are added until the basis stays; none, if it does not with ``MOST_COLUMNS``."""
    spark, rows, val = own.splines.tiles.sparkSession, _as_columns(own.train), _as_columns(own.val)
    n, t = own.train.n, own.train.n + own.val.n
    space = written(spectra.combined(rows, _whitened(spectra.crossed(rows))))
    block, omega, last, widest = space, np.zeros((0, 0)), None, n
    while True:
        moved = splines.smoothed(own.splines, block)
        g = spectra.crossed(spectra.beside([rows, val, space, moved]))
        m, b = splines.width(space), splines.width(block)
        of_rows, inner, new = g[:t, t : t + m], g[t : t + m, t + m :], np.zeros((m, m))
        new[: len(omega), : len(omega)] = omega
        new[:, m - b :], new[m - b :, :] = inner, inner.T
        omega = (new + new.T) / 2
        outside = max(0.0, own.val.trace - float((of_rows[n:] ** 2).sum()))
        fit = in_task(spark, _fit_in_space, of_rows[:n], of_rows[n:], outside, omega, own.n, k, tau1, 0.0, y_sd, y_square, o) if m >= k else None
        if fit is not None and last is not None:
            before = np.vstack([last, np.zeros((m - len(last), k))])
            sign = np.where(np.sum(before * fit.phi, 0) < 0, -1, 1)
            settled = np.abs(before * sign - fit.phi).max() <= SETTLED
        else:
            settled = False
        if not settled and m < own.n:
            if m + widest > MOST_COLUMNS:
                return None
            off = written(spectra.combined(spectra.beside([moved, space]), np.vstack([np.eye(b), -inner])))
            again = spectra.crossed(spectra.beside([space, off]))
            c = again[:m, m:]
            white = _whitened(again[m:, m:] - c.T @ c)
            if np.trace(again[m:, m:]) > 1e-20 * max(1e-300, np.trace(g[t + m :, t + m :])):
                block = written(spectra.combined(spectra.beside([off, space]), np.vstack([white, -c @ white])))
                space = written(spectra.beside([space, block]))
                last = None if fit is None else fit.phi
                continue
        if fit is None:
            return None
        columns = written(spectra.combined(space, fit.phi))
        found = spectra.Leading(np.zeros(k), columns, own.train.sites, 0.0, 0)
        return TallFit(found.signed(), own.train.sites, fit.best_rmse, fit.history)


def fit_tall(train: DataFrame, val: DataFrame, sites: DataFrame, k: int, tau1: float, tau2: float, y_sd: float, y_square: float, options: FitOptions | None = None, value: str = "v", block: int = splines.BLOCK) -> TallFit:
    """The basis of residuals (t, site_id, value) that are complete at train and at val times; other arguments as for
    ``models.fit_basis``, whose rounds these are."""
    o = options or FitOptions()
    own = Problem(train, val, sites, value, block)
    if not tau2 and 0 < own.train.n <= MOST_TIMES and 0 < own.val.n <= MOST_TIMES:
        fit = _fit_in_subspace(own, k, tau1, y_sd, y_square, o)
        if fit is not None:
            return fit
    n, cells = own.n, max(1, own.train.n * own.n)
    blocks, rough = own.train.sites, splines.trace(own.splines) if tau2 else 0.0

    def top(multiply) -> spectra.Leading:
        return spectra.leading(blocks, multiply, k)

    start = Map(1.0, np.zeros((0, 0)))
    first = spectra.leading(blocks, lambda x: spectra.combined(spectra.beside([own.times(own.train, x), splines.smoothed(own.splines, x)]), np.vstack([np.eye(splines.width(x)), -tau1 * np.eye(splines.width(x))])).select("sb", "x"), k)
    phi = first.signed()
    a, b, rho, best, history = start, Map(0.0, np.zeros((0, 0))), o.rho * y_sd, np.inf, []
    last = np.zeros((0, k))
    size = lambda x: float(np.sqrt(max(0.0, x.square(own.train.trace, own.of_train, own.inner) / cells)))
    for i in range(o.rounds):
        change, updated = 0.0, i % o.every == 0 and i < o.freeze
        if updated:
            ridge = o.ridge * own.target_trace(a, tau1, rough) / n if tau2 else 0.0
            multiply = own.target(a, tau1, ridge)
            found = top(multiply)
            new = found.signed()
            if tau2:
                low = spectra.leading(blocks, lambda x: spectra.combined(multiply(x).join(x.select("sb", "n"), "sb").select("sb", "n", "x"), -np.eye(splines.width(x))).select("sb", "x"), 1)
                new = _sparse(blocks, multiply, max(abs(found.values[0]), abs(low.values[0])), new, tau2, o)
            change, phi = _change(new, phi), new
        if updated or not len(own.inner):
            own.add(phi)
            a, b = a.grown(k), b.grown(k)
            last = np.vstack([np.zeros((len(own.inner) - k, k)), np.eye(k)])
        before, eye = a, Map(1.0, np.zeros_like(own.inner))
        rest = eye.plus(b, -1)
        onto = last @ last.T
        a = Map(rho * rest.c / (rho + 2), (rho * rest.x + 2 * (rest.c * onto + rest.x @ own.inner @ onto)) / (rho + 2))
        moved = a.plus(eye, -1)
        b = b.plus(moved, 1 + o.momentum)
        error = Map(1.0, -(a.c * onto + a.x @ own.inner @ onto))
        rmse = float(np.sqrt(max(0.0, error.square(own.val.trace, own.of_val, own.inner) / max(1, own.val.n * n))))
        best = min(best, rmse)
        primal, dual = size(moved), rho * size(a.plus(before, -1))
        eps_primal = o.tolerance + 10 * o.tolerance * max(size(a), size(eye), 1e-12)
        eps_dual = o.tolerance + 10 * o.tolerance * max(np.sqrt(y_square), 1e-12)
        history.append({"round": i + 1, "primal": primal, "dual": dual, "change": change, "rmse": rmse})
        if i + 1 >= o.least_rounds and dual <= eps_dual and change <= eps_primal:
            break
    return TallFit(phi, blocks, best, history)


def diagnostics(cells: DataFrame, sites: DataFrame, phi: DataFrame, tau1: float, tau2: float, value: str = "v", block: int = splines.BLOCK) -> dict[str, float]:
    """``models.fit_diagnostics`` of a complete panel and a long basis: residuals of the projection, the roughness of the
    basis by its splines, and the sum of its entries."""
    d = F.col(value) - F.col("fitted")
    recon = projected(cells, phi, value).agg(F.avg(d * d)).first()[0]
    s = splines.splines(sites.join(cells.select("site_id").distinct(), "site_id", "left_semi"), block=block)
    columns = written(splines.columns_of(s, phi))
    k = splines.width(columns)
    rough = spectra.crossed(spectra.beside([columns, splines.roughness(s, columns)]))[:k, k:]
    l1, n = phi.agg(F.sum(F.abs("phi"))).first()[0], columns.agg(F.sum("n")).first()[0]
    return diagnostics_of(recon, tau1 * float(np.trace(rough)), tau2 * l1, n, k)
