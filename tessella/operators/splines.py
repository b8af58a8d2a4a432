"""Thin-plate splines and their roughness for any number of sites, on tiles of a matrix.

With the kernel k, which is positive on vectors that are orthogonal to linear functions, a spline through
values f has weights w and a linear part c with (k + e) w + P c = f and P'w + e c = 0. The kernel is made
positive on all vectors by its values at d + 1 corners of the sites' box; what that changes is made good by
a small system. The matrix of all sites is held in tiles of two blocks of sites, on and above the diagonal,
and inverted by sweeps: each takes one block's column of tiles to all others. So no task holds more than
three tiles, and after that a spline, or the roughness of some columns, is one product of the tiles with
columns (tables with one row for each block of sites, see ``spectra``); the driver solves 2 (d + 1) unknowns.

The work is that of an inverse, cubic in the sites, and the tiles' size is quadratic.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.storage import released, written
from tessella.operators import spectra
from tessella.operators.panel import index_of

BLOCK, RIDGE = 512, 1e-8


def spline_kernel(r: np.ndarray, d: int) -> np.ndarray:
    if d not in (1, 2, 3):
        raise ValueError("coordinates have 1, 2 or 3 dimensions")
    safe = np.where(r < 1e-8, 1.0, r)
    k = {1: safe**3 / 12, 2: safe**2 * np.log(safe) / (8 * np.pi), 3: -safe / (8 * np.pi)}[d]
    return np.where(r < 1e-8, 0.0, k)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))


@dataclass
class Kernel:
    """``low`` and ``span``: the sites' box."""

    low: np.ndarray
    span: np.ndarray

    def linear(self, x: np.ndarray) -> np.ndarray:
        """The linear functions that are 1 at one corner of the box and 0 at the others."""
        own = (x - self.low) / self.span
        return np.column_stack([1 - own.sum(1), own])

    def turn(self) -> np.ndarray:
        """The matrix that takes (1, x) to ``linear``."""
        d, t = len(self.low), self.low / self.span
        out = np.zeros((d + 1, d + 1))
        out[0, 0], out[0, 1:] = 1 + t.sum(), -t
        out[1:, 0], out[1:, 1:] = -1 / self.span, np.diag(1 / self.span)
        return out

    def corners(self) -> np.ndarray:
        return self.low + np.vstack([np.zeros(len(self.low)), np.diag(self.span)])

    def plain(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return spline_kernel(distances(x, y), len(self.low))

    def at_corners(self) -> np.ndarray:
        return self.plain(self.corners(), self.corners()) + np.eye(len(self.low) + 1)

    def positive(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at, to, corners, k = self.linear(x), self.linear(y), self.corners(), self.plain
        return k(x, y) - at @ k(corners, y) - k(x, corners) @ to.T + at @ self.at_corners() @ to.T


@dataclass
class Splines:
    """``tiles`` (i, j, x) for i <= j: the inverse of the kernel matrix; ``sites`` (sb, n, ids, at): the blocks; ``side``
    (sb, n, x): the linear functions at the sites and the kernel's values at the corners, ``solved``: the inverse
    times these, ``cross``: their product."""

    kernel: Kernel
    tiles: DataFrame
    sites: DataFrame
    side: DataFrame
    solved: DataFrame
    cross: np.ndarray


def _points(at) -> np.ndarray:
    return np.stack([np.asarray(p, float) for p in at])


def blocks_of(sites: DataFrame, coordinates: Sequence[str], size: int) -> DataFrame:
    """(sb, n, ids, at): sites in the order of their ids."""
    own = sites.join(index_of(sites, ["site_id"], "i"), "site_id")
    entry = F.struct("i", "site_id", F.array(*[F.col(c).cast("double") for c in coordinates]).alias("at"))
    blocks = own.withColumn("sb", F.floor(F.col("i") / size).cast("int")).groupBy("sb").agg(F.sort_array(F.collect_list(entry)).alias("c"))
    return blocks.select("sb", F.size("c").alias("n"), F.col("c.site_id").alias("ids"), F.col("c.at").alias("at"))


def _kernel_tiles(sites: DataFrame, blocks: int, kernel: Kernel) -> DataFrame:
    copies = sites.select("sb", "at", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    copies = copies.withColumns({"i": F.least("sb", "other"), "j": F.greatest("sb", "other")})

    def one(f: pd.DataFrame) -> pd.DataFrame:
        at = dict(zip(f["sb"], map(_points, f["at"])))
        i, j = int(f["i"].iloc[0]), int(f["j"].iloc[0])
        k = kernel.positive(at[i], at[j])
        return pd.DataFrame({"i": [i], "j": [j], "x": [(k + RIDGE * np.eye(len(k)) if i == j else k).tobytes()]})

    return copies.groupBy("i", "j").applyInPandas(one, "i int, j int, x binary")


def _swept(tiles: DataFrame, k: int) -> DataFrame:
    """One sweep: the pivot becomes minus its inverse, its column the column times that inverse, and all others lose
    what the pivot explains of them."""

    def sides(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                pivot, x = np.frombuffer(r.pivot), np.frombuffer(r.x)
                pivot = pivot.reshape(round(len(pivot) ** 0.5), -1)
                if r.i == r.j:
                    raw, over = pivot, -np.linalg.inv(pivot)
                else:
                    raw = x.reshape(-1, len(pivot)) if r.j == k else x.reshape(len(pivot), -1).T
                    over = np.linalg.solve(pivot, raw.T).T  # more exact than the product with the inverse
                yield pd.DataFrame({"b": [r.j if r.i == k else r.i], "raw": [np.ascontiguousarray(raw).tobytes()], "over": [np.ascontiguousarray(over).tobytes()], "size": [len(pivot)]})

    pivot = tiles.where((F.col("i") == k) & (F.col("j") == k)).select(F.col("x").alias("pivot"))
    column = tiles.where((F.col("i") == k) | (F.col("j") == k)).join(F.broadcast(pivot))
    column = written(column.mapInPandas(sides, "b int, raw binary, over binary, size int"))
    left, right = column.select(F.col("b").alias("i"), F.col("over").alias("a"), "size"), column.select(F.col("b").alias("j"), F.col("raw").alias("c"), F.col("over").alias("d"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                a, c, d = (np.frombuffer(x).reshape(-1, r.size) for x in (r.a, r.c, r.d))
                x = a if r.j == k else d.T if r.i == k else np.frombuffer(r.x).reshape(len(a), -1) - a @ c.T
                yield pd.DataFrame({"i": [r.i], "j": [r.j], "x": [np.ascontiguousarray(x).tobytes()]})

    out = written(tiles.join(left, "i").join(right, "j").mapInPandas(run, "i int, j int, x binary"))
    released(tiles, column)
    return out


def _product(tiles: DataFrame, columns: DataFrame) -> DataFrame:
    """Minus the swept tiles times columns (sb, n, x): (sb, n, x)."""
    both = tiles.select("i", "j", "x", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("turned"))
    both = both.withColumns({"to": F.when(F.col("turned"), F.col("j")).otherwise(F.col("i")), "sb": F.when(F.col("turned"), F.col("i")).otherwise(F.col("j"))})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                y = np.frombuffer(r.y).reshape(r.n, -1)
                tile = np.frombuffer(r.x)
                tile = tile.reshape(r.n, -1).T if r.turned else tile.reshape(-1, r.n)
                yield pd.DataFrame({"sb": [r.to], "x": [(-(tile @ y)).tobytes()]})

    parts = both.join(columns.select("sb", "n", F.col("x").alias("y")), "sb").select("to", "n", "turned", "x", "y").mapInPandas(run, "sb int, x binary")
    return spectra.joined(parts, "sb").join(columns.select("sb", "n"), "sb").select("sb", "n", "x")


def splines(sites: DataFrame, coordinates: Sequence[str] = ("x", "y"), block: int = BLOCK) -> Splines:
    """The inverse for the sites (site_id, coordinates), whose places are different."""
    own = written(blocks_of(sites, coordinates, block))
    row = sites.agg(*[f(c).cast("double") for c in coordinates for f in (F.min, F.max)]).first()
    low, high = np.array(row[::2], float), np.array(row[1::2], float)
    kernel, count = Kernel(low, np.where(high > low, high - low, 1.0)), own.count()
    tiles = written(_kernel_tiles(own, count, kernel))
    for k in range(count):
        tiles = _swept(tiles, k)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                yield pd.DataFrame({"sb": [r.sb], "n": [r.n], "x": [np.hstack([kernel.linear(_points(r.at)), kernel.plain(_points(r.at), kernel.corners())]).tobytes()]})

    side = written(own.mapInPandas(run, "sb int, n int, x binary"))
    solved = written(_product(tiles, side))
    d = 2 * len(low) + 2
    return Splines(kernel, tiles, own, side, solved, spectra.crossed(spectra.beside([side, solved]))[:d, d:])


def _kernel_times(s: Splines, columns: DataFrame) -> DataFrame:
    """The kernel matrix, with its ridge, times columns: (sb, x). Kernels are computed where they are used."""
    own = s.sites.select("sb", "at")
    pairs = own.select(F.col("sb").alias("to"), F.col("at").alias("here"), F.explode(F.sequence(F.lit(0), F.lit(own.count() - 1))).alias("sb"))
    kernel = s.kernel

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                k = kernel.plain(_points(r.here), _points(r.at))
                k = k + RIDGE * np.eye(len(k)) if r.to == r.sb else k
                yield pd.DataFrame({"sb": [r.to], "x": [(k @ np.frombuffer(r.x).reshape(r.n, -1)).tobytes()]})

    return spectra.joined(pairs.join(own, "sb").join(columns, "sb").mapInPandas(run, "sb int, x binary"), "sb")


def _system(s: Splines) -> np.ndarray:
    """Of q, what is taken off in all, and c, the linear part; the weights' sums with the linear functions are m =
    t'(g - e c)."""
    d = len(s.kernel.low) + 1
    ll, lk, kl, kk = s.cross[:d, :d], s.cross[:d, d:], s.cross[d:, :d], s.cross[d:, d:]
    t, eye = s.kernel.turn(), np.eye(d)
    return np.block([[ll, -RIDGE * (lk + eye) @ t.T], [kl + eye, -np.linalg.inv(t) - RIDGE * (kk + s.kernel.at_corners()) @ t.T]])


def _solved(s: Splines, columns: DataFrame, g: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """w and c of (k + e) w + P c = columns and P'w + e c = g (none: 0)."""
    first, d = written(_product(s.tiles, columns)), len(s.kernel.low) + 1
    right = spectra.crossed(spectra.beside([s.side, first]))[: 2 * d, 2 * d :]
    g, t = np.zeros((d, right.shape[1])) if g is None else g, s.kernel.turn()
    of_g = np.vstack([(s.cross[:d, d:] + np.eye(d)) @ t.T @ g, (s.cross[d:, d:] + s.kernel.at_corners()) @ t.T @ g])
    q, c = np.split(np.linalg.solve(_system(s), right - of_g), 2)
    off = np.vstack([q, t.T @ (g - RIDGE * c)])
    return written(spectra.combined(spectra.beside([first, s.solved]), np.vstack([np.eye(c.shape[1]), -off]))), c


def smoothed(s: Splines, columns: DataFrame) -> DataFrame:
    """The smoothing matrix times columns but for a part of the ridge's size: their splines' weights."""
    return _solved(s, columns)[0]


def trace(s: Splines) -> float:
    """Of that matrix: the inverse's, less what the linear functions take off."""

    def diagonals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for x in frame["x"]:
                m = np.frombuffer(x)
                yield pd.DataFrame({"v": [-float(np.trace(m.reshape(round(len(m) ** 0.5), -1)))]})

    own = s.tiles.where("i = j").mapInPandas(diagonals, "v double").agg(F.sum("v")).first()[0]
    d = len(s.kernel.low) + 1
    off = np.linalg.inv(_system(s))
    off[d:] = -RIDGE * s.kernel.turn().T @ off[d:]
    return float(own - np.trace(off @ spectra.crossed(s.solved)))


def _with_linear(s: Splines, parts: list[DataFrame], c: np.ndarray, factors: list[float]) -> DataFrame:
    """The sum of tables of columns, times their factors, less the linear functions P c."""
    m, d = c.shape[1], len(s.kernel.low) + 1
    linear = np.vstack([np.linalg.solve(s.kernel.turn(), c), np.zeros((d, m))])
    return written(spectra.combined(spectra.beside([s.side, *parts]), np.vstack([-linear, *[f * np.eye(m) for f in factors]])))


def weights(s: Splines, columns: DataFrame, refined: int = 1) -> tuple[DataFrame, np.ndarray]:
    """For each of some columns of values (sb, n, x): the weights (sb, n, x) of its spline, and its linear part, as
    factors of (1, x). What a solution leaves of the columns is solved for ``refined`` times more, as products
    with an inverse are less exact than a solve."""
    w, c = _solved(s, columns)
    for _ in range(refined):
        left = _with_linear(s, [columns, _kernel_times(s, w)], c, [1.0, -1.0])
        d = len(c)
        sums = spectra.crossed(spectra.beside([s.side, w]))[:d, 2 * d :]
        dw, dc = _solved(s, left, -np.linalg.solve(s.kernel.turn().T, sums) - RIDGE * c)
        m = c.shape[1]
        w, c = written(spectra.combined(spectra.beside([w, dw]), np.vstack([np.eye(m), np.eye(m)]))), c + dc
    return w, c


def roughness(s: Splines, columns: DataFrame) -> DataFrame:
    """The smoothing matrix times columns: the weights of what the kernel makes of their weights."""
    w, c = weights(s, columns)
    return weights(s, _with_linear(s, [columns, w], c, [1.0, -RIDGE]))[0]


def width(columns: DataFrame) -> int:
    row = columns.select((F.octet_length("x") / 8 / F.col("n")).cast("int")).first()
    return row[0] if row else 0


def columns_of(s: Splines, phi: DataFrame) -> DataFrame:
    """A long basis (site_id, k, phi) as columns (sb, n, x) of the blocks; 0 where it has no row."""
    k = phi.agg(F.max("k")).first()[0] + 1
    rows = s.sites.select("sb", "n", F.posexplode("ids").alias("pos", "site_id")).join(phi, "site_id", "left")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        out, seen = np.zeros((int(f["n"].iloc[0]), k)), f["k"].notna().to_numpy()
        out[f["pos"].to_numpy()[seen], f["k"].to_numpy()[seen].astype(int)] = f["phi"].to_numpy(float)[seen]
        return pd.DataFrame({"sb": f["sb"].iloc[:1], "n": f["n"].iloc[:1], "x": [out.tobytes()]})

    return rows.groupBy("sb").applyInPandas(run, "sb int, n int, x binary")


def interpolated(s: Splines, phi: DataFrame, new_sites: DataFrame, coordinates: Sequence[str] = ("x", "y"), block: int = BLOCK) -> DataFrame:
    """(site_id, phi array<double>) at new sites, by the splines through a long basis: every block of new sites
    meets every block of sites in a task, and what they add is summed up."""
    w, part = weights(s, written(columns_of(s, phi)))
    own = written(w.join(s.sites.select("sb", F.col("at").alias("there")), "sb"))
    asked = written(blocks_of(new_sites, coordinates, block).withColumnRenamed("sb", "nb").withColumnRenamed("n", "m"))
    kernel, count = s.kernel, own.count()
    dealt = asked.select("nb", "m", "at", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("sb")).join(own, "sb")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                at = _points(r.at)
                out = kernel.plain(at, _points(r.there)) @ np.frombuffer(r.x).reshape(r.n, -1)
                out = out + np.column_stack([np.ones(len(at)), at]) @ part if r.sb == 0 else out
                yield pd.DataFrame({"nb": [r.nb], "x": [out.tobytes()]})

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                yield pd.DataFrame({"site_id": np.asarray(r.ids), "phi": list(np.frombuffer(r.x).reshape(r.m, -1))})

    return spectra.joined(dealt.mapInPandas(run, "nb int, x binary"), "nb").join(asked.select("nb", "m", "ids"), "nb").mapInPandas(spread, "site_id long, phi array<double>")


def penalised(cells: DataFrame, sites: DataFrame, k: int, tau1: float, value: str = "v", coordinates: Sequence[str] = ("x", "y"), block: int = BLOCK, **options) -> tuple[spectra.Leading, Splines]:
    """The k leading eigenvectors of R'R - tau1 times the smoothing matrix, of a complete panel (t, site_id, value). Its
    product with columns is their splines' weights, but for a part of the ridge's size."""
    own = spectra.tiled(cells, value, sites=block)
    s = splines(sites.join(cells.select("site_id").distinct(), "site_id", "left_semi"), coordinates, block)

    def multiply(columns: DataFrame) -> DataFrame:
        both = spectra.beside([written(spectra.product(own, columns).join(columns.select("sb", "n"), "sb").select("sb", "n", "x")), smoothed(s, columns)])
        m = width(columns)
        return spectra.combined(both, np.vstack([np.eye(m), -tau1 * np.eye(m)])).select("sb", "x")

    return spectra.leading(own.sites, multiply, k, **options), s
