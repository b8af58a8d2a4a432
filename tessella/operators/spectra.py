"""Leading eigenpairs of large symmetric forms: block Davidson rounds on a long panel.

A panel is packed once into tiles, a block of sites by a span of times each. A round multiplies R'R by a
few columns (one for each wanted pair, and some more): tiles meet the columns' site blocks, products
are added up by span, meet the tiles again and are added up by site block. Columns are tables with one
row for each site block. The driver sees only small square matrices, of the columns with each other,
from which it takes the best combinations (Rayleigh-Ritz) and the next columns (what is left of R'R v - l v).
So neither sites nor times are bounded, and no sites x sites matrix exists anywhere.

A lost executor repeats its tasks of one round at most: each round's columns are written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.storage import written
from tessella.operators.panel import index_of

SITES, TIMES = 512, 512


@dataclass
class Tiles:
    """``tiles`` (sb, tb, tile): times x sites matrices; ``sites`` (sb, n, ids): the sites of each block in order;
    ``n``: times; ``trace``: the sum of all squares."""

    tiles: DataFrame
    sites: DataFrame
    n: int
    trace: float


def joined(parts: DataFrame, key: str) -> DataFrame:
    """(key, x): the sum of the matrices of each key, a pair of 16 partial sums at most meeting in one task."""

    def add(f: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(f["x"].iloc[0]).copy()
        for x in f["x"].iloc[1:]:
            total += np.frombuffer(x)
        return pd.DataFrame({key: f[key].iloc[:1], "salt": [0], "x": [total.tobytes()]})

    schema = f"{key} int, salt int, x binary"
    some = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    return some.groupBy(key, "salt").applyInPandas(add, schema).groupBy(key).applyInPandas(add, schema).select(key, "x")


def tiled(cells: DataFrame, value: str = "v", centred: bool = False, sites: int = SITES, times: int = TIMES) -> Tiles:
    """Of a complete panel (t, site_id, value); ``centred``: less each site's mean."""
    own = cells.select("t", "site_id", F.col(value).cast("double").alias("v"))
    if centred:
        mean = own.groupBy("site_id").agg(F.avg("v").alias("m"))
        own = own.join(mean, "site_id").select("t", "site_id", (F.col("v") - F.col("m")).alias("v"))
    i, j = index_of(own, ["site_id"], "i"), index_of(own, ["t"], "j")
    place = lambda c, size, block: [F.floor(F.col(c) / size).cast("int").alias(block), (F.col(c) % size).cast("int").alias(c)]
    named = written(i.select("site_id", *place("i", sites, "sb")))
    cells = own.join(named, "site_id").join(j.select("t", *place("j", times, "tb")), "t")

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((f["j"].max() + 1, f["i"].max() + 1))
        out[f["j"], f["i"]] = f["v"]
        return pd.DataFrame({"sb": f["sb"].iloc[:1], "tb": f["tb"].iloc[:1], "tile": [out.tobytes()], "trace": [float((out * out).sum())]})

    tiles = written(cells.groupBy("sb", "tb").applyInPandas(pack, "sb int, tb int, tile binary, trace double"))
    blocks = written(named.groupBy("sb").agg(F.count("*").cast("int").alias("n"), F.sort_array(F.collect_list(F.struct("i", "site_id"))).getField("site_id").alias("ids")))
    row = tiles.agg(F.coalesce(F.sum("trace"), F.lit(0.0))).first()
    return Tiles(tiles.drop("trace"), blocks, j.count(), row[0])


def product(own: Tiles, columns: DataFrame) -> DataFrame:
    """R'R times columns (sb, n, x): (sb, x)."""

    def along(f: Callable[[np.ndarray, np.ndarray, int], np.ndarray], key: str):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for r in frame.itertuples():
                    tile = np.frombuffer(r.tile).reshape(-1, r.n)
                    yield pd.DataFrame({key: [getattr(r, key)], "x": [f(tile, np.frombuffer(r.x)).tobytes()]})

        return run

    sized = own.tiles.join(columns.select("sb", "n"), "sb")
    eta = joined(own.tiles.join(columns, "sb").mapInPandas(along(lambda tile, x: tile @ x.reshape(tile.shape[1], -1), "tb"), "tb int, x binary"), "tb")
    return joined(sized.join(eta, "tb").mapInPandas(along(lambda tile, x: tile.T @ x.reshape(tile.shape[0], -1), "sb"), "sb int, x binary"), "sb")


def crossed(columns: DataFrame) -> np.ndarray:
    """The square matrix of all columns (sb, n, x) with each other."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            for r in frame.itertuples():
                x = np.frombuffer(r.x).reshape(r.n, -1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"g": [0], "x": [total.tobytes()]})

    row = joined(columns.mapInPandas(run, "g int, x binary"), "g").first()
    size = 0 if row is None else round((len(row.x) // 8) ** 0.5)
    return np.frombuffer(row.x).reshape(size, size) if row else np.zeros((0, 0))


def combined(columns: DataFrame, weights: np.ndarray) -> DataFrame:
    """Columns (sb, n, x) times a small matrix."""
    weights = np.asarray(weights)
    return applied(columns, lambda x: x @ weights)


def applied(columns: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``f`` of the rows of columns, which knows no row of another site."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                yield pd.DataFrame({"sb": [r.sb], "n": [r.n], "x": [np.ascontiguousarray(f(np.frombuffer(r.x).reshape(r.n, -1))).tobytes()]})

    return columns.mapInPandas(run, "sb int, n int, x binary")


def beside(parts: list[DataFrame]) -> DataFrame:
    """The columns of ``parts`` in one table; the first has ``n``."""
    out = parts[0].withColumnRenamed("x", "x0")
    for i, p in enumerate(parts[1:], 1):
        out = out.join(p.select("sb", F.col("x").alias(f"x{i}")), "sb")

    count = len(parts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                x = [np.frombuffer(getattr(r, f"x{i}")).reshape(r.n, -1) for i in range(count)]
                yield pd.DataFrame({"sb": [r.sb], "n": [r.n], "x": [np.concatenate(x, 1).tobytes()]})

    return out.mapInPandas(run, "sb int, n int, x binary")


def _started(sites: DataFrame, width: int) -> DataFrame:
    """Columns of seeded normal numbers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                yield pd.DataFrame({"sb": [r.sb], "n": [r.n], "x": [np.random.default_rng([17, int(r.sb)]).normal(size=(r.n, width)).tobytes()]})

    return sites.mapInPandas(run, "sb int, n int, x binary")


@dataclass
class Leading:
    """Eigenvalues, largest first, and their vectors as columns (sb, n, x); ``left``: the largest |A v - l v|."""

    values: np.ndarray
    columns: DataFrame
    sites: DataFrame
    left: float
    rounds: int

    def signs(self) -> np.ndarray:
        """Those that make each vector's largest entry positive."""
        k = len(self.values)

        def tops(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for r in frame.itertuples():
                    x = np.frombuffer(r.x).reshape(r.n, k)
                    at = np.abs(x).argmax(0)
                    yield pd.DataFrame({"k": np.arange(k), "v": x[at, np.arange(k)]})

        top = self.columns.mapInPandas(tops, "k long, v double").groupBy("k").agg(F.max_by("v", F.struct(F.abs("v"), -F.col("v"))).alias("v")).collect()
        sign = np.ones(k)
        for r in top:
            sign[r.k] = -1.0 if r.v < 0 else 1.0
        return sign

    def signed(self) -> DataFrame:
        return written(combined(self.columns, np.diag(self.signs())))

    def long(self, signed: bool = True) -> DataFrame:
        """(site_id, k, phi)."""
        k, sign = len(self.values), self.signs() if signed else np.ones(len(self.values))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for r in frame.itertuples():
                    x = np.frombuffer(r.x).reshape(r.n, k) * sign
                    yield pd.DataFrame({"site_id": np.repeat(np.asarray(r.ids), k), "k": np.tile(np.arange(k), r.n), "phi": x.ravel()})

        return self.columns.join(self.sites.select("sb", "ids"), "sb").mapInPandas(run, "site_id long, k long, phi double")


def leading(sites: DataFrame, multiply: Callable[[DataFrame], DataFrame], k: int, *, extra: int = 8, keep: int = 6, tolerance: float = 1e-7, rounds: int = 60) -> Leading:
    """The k largest eigenvalues of a symmetric matrix that is known by its products: ``multiply`` takes columns
    (sb, n, x) of the blocks of ``sites`` (sb, n, ids) and gives (sb, x).

    Each round adds ``k + extra`` columns; at ``keep`` times as many only the best combinations stay. It ends when
    the k wanted ones leave less than ``tolerance`` times the largest eigenvalue, one round after that, or when
    the columns hold all that the matrix has to give; a matrix with fewer columns has fewer pairs."""
    total = sites.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wide, k = min(k + extra, total), min(k, total)
    if not k:
        return Leading(np.zeros(0), combined(sites.select("sb", "n").withColumn("x", F.lit(b"")), np.zeros((0, 0))), sites, 0.0, 0)
    block = written(_started(sites.select("sb", "n"), wide))
    state = written(beside([block, multiply(block)]))
    m, last = wide, False
    for i in range(1, rounds + 1):
        g = crossed(state)
        inner, form, square = g[:m, :m], g[:m, m:], g[m:, m:]
        size, turn = np.linalg.eigh((inner + inner.T) / 2)
        own = size > 1e-12 * size[-1]
        white = turn[:, own] / np.sqrt(size[own])
        h = white.T @ form @ white
        values, vectors = np.linalg.eigh((h + h.T) / 2)
        z = (white @ vectors)[:, ::-1]
        values = values[::-1]
        if z.shape[1] > keep * wide:
            z, values = z[:, : 2 * wide], values[: 2 * wide]
        s = z.shape[1]
        zero = np.zeros((m, s))
        turned = np.block([[z, zero], [zero, z]])
        residual = np.einsum("ij,ij->j", z, square @ z) - values**2
        off = np.sqrt(np.maximum(residual, 0))
        scale = max(abs(values[0]), abs(values[-1]), 1e-300)
        most = float(off[:k].max())
        done = last or s >= total
        last = most <= tolerance * scale
        go = np.flatnonzero(off[:wide] > 1e-12 * scale)
        if done or not len(go) or i == rounds:
            break
        # What is left of the first pairs, brought to length 1, is the next block.
        next_block = np.vstack([-z[:, go] * values[go], z[:, go]]) / off[go]
        block = combined(state, next_block)
        w = multiply(block)
        state = written(_with_block(state, w, turned, next_block, s))
        m = s + len(go)
    return Leading(values[:k], written(combined(state, turned[:, :k])), sites, most, i)


def _with_block(state: DataFrame, w: DataFrame, turned: np.ndarray, block: np.ndarray, s: int) -> DataFrame:
    """(columns, block, products of columns, products of the block)"""
    both = state.join(w.select("sb", F.col("x").alias("w")), "sb")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                x = np.frombuffer(r.x).reshape(r.n, -1)
                new = x @ turned
                out = np.concatenate([new[:, :s], x @ block, new[:, s:], np.frombuffer(r.w).reshape(r.n, -1)], 1)
                yield pd.DataFrame({"sb": [r.sb], "n": [r.n], "x": [out.tobytes()]})

    return both.mapInPandas(run, "sb int, n int, x binary")


def of_panel(cells: DataFrame, k: int, value: str = "v", centred: bool = False, **options) -> tuple[Leading, Tiles]:
    own = tiled(cells, value, centred)
    return leading(own.sites, lambda x: product(own, x), k, **options), own


def covariance_spectrum(cells: DataFrame, k: int, value: str = "v") -> tuple[DataFrame, Leading]:
    """(component, eigenvalue, cumulative_explained_variance) of the sample covariance of a complete panel: the k
    leading ones, and all others together under a null component, whose sum is what the trace leaves."""
    found, own = of_panel(cells, k, value, centred=True)
    if own.n < 2:
        raise ValueError("a covariance needs two rows")
    values, trace = found.values / (own.n - 1), own.trace / (own.n - 1)
    shares = np.cumsum(values) / trace if trace else np.zeros_like(values)
    rows = [(i + 1, float(v), float(s)) for i, (v, s) in enumerate(zip(values, shares))]
    rows.append((None, float(trace - values.sum()), 1.0 if trace else 0.0))
    return cells.sparkSession.createDataFrame(rows, "component int, eigenvalue double, cumulative_explained_variance double"), found


def cosines(a: DataFrame, b: DataFrame) -> DataFrame:
    """(component, cosine): absolute cosines of the columns with the same number of two long bases."""
    both = a.join(b.select("site_id", "k", F.col("phi").alias("p")), ["site_id", "k"])
    norm = F.sqrt(F.sum(F.col("phi") * F.col("phi"))) * F.sqrt(F.sum(F.col("p") * F.col("p")))
    return both.groupBy((F.col("k") + 1).cast("int").alias("component")).agg((F.abs(F.sum(F.col("phi") * F.col("p"))) / norm).alias("cosine"))
