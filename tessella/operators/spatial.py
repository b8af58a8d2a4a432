"""Pairs of sites, neighbours, variograms and Matérn correlation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache
from math import factorial, gamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import distance
from tessella.functions.storage import written
from tessella.operators import strips
from tessella.operators.panel import index_of

XY = ("x", "y")


def pairs_within(sites: DataFrame, most: float, coordinates: Sequence[str] = XY, key: str = "site_id") -> DataFrame:
    """(i, j, h) with i < j and distance h of at most ``most``. Sites go to grid cells as wide as
    that; one side looks into the neighbouring cells, so the join is on cells, not on all pairs."""
    cells = [F.floor(F.col(c) / most) for c in coordinates]
    left = sites.select(F.col(key).alias("i"), *[F.col(c).alias(f"a_{c}") for c in coordinates], *[c.alias(f"_c{n}") for n, c in enumerate(cells)])
    right = sites.select(F.col(key).alias("j"), *[F.col(c).alias(f"b_{c}") for c in coordinates], *[c.alias(f"_c{n}") for n, c in enumerate(cells)])
    for n in range(len(cells)):
        right = right.withColumn(f"_c{n}", F.explode(F.array(*[F.col(f"_c{n}") + step for step in (-1, 0, 1)])))
    h = distance([F.col(f"a_{c}") for c in coordinates], [F.col(f"b_{c}") for c in coordinates])
    return left.join(right, [f"_c{n}" for n in range(len(cells))]).where("i < j").select("i", "j", h.alias("h")).where(F.col("h") <= most)


def nearest(sites: DataFrame, k: int = 4, coordinates: Sequence[str] = XY, key: str = "site_id", reach: float | None = None) -> DataFrame:
    """(i, j, h, rank): the k nearest other sites. Neighbours are searched within a reach that starts where
    k of them are expected; sites that have not found k yet, and only these, go on with twice the reach.
    Each round's rows are written, so no round is computed again."""
    stats = sites.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in coordinates]).first()
    n = stats["n"]
    wanted = min(k, max(0, n - 1))
    span = max([1e-9, *[float(stats[c] or 0) for c in coordinates]])
    reach = reach or span * min(1.0, 2.0 * ((wanted + 1) / max(1, n)) ** (1 / len(coordinates)))
    asking, out = sites.select(key, *coordinates), None
    while True:
        rows = neighbours_within(asking, sites, reach, coordinates, key)
        best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("h", "j"))).where(F.col("rank") <= wanted)
        best = written(best.withColumn("found", F.count("*").over(Window.partitionBy("i"))))
        last = reach >= 4 * span
        done = best if last else best.where(F.col("found") >= wanted)
        out = done if out is None else out.unionByName(done)
        asking = asking.join(done.select(F.col("i").alias(key)).distinct(), key, "left_anti")
        if last or not wanted or not asking.head(1):
            return out.drop("found")
        reach *= 2


def neighbours_within(asking: DataFrame, sites: DataFrame, most: float, coordinates: Sequence[str] = XY, key: str = "site_id") -> DataFrame:
    """(i, j, h): for each asking site the other sites at a distance of at most ``most``; a join on grid
    cells as wide as that, into whose neighbours the asking sites look."""
    cells = [F.floor(F.col(c) / most) for c in coordinates]
    left = asking.select(F.col(key).alias("i"), *[F.col(c).alias(f"a_{c}") for c in coordinates], *[c.alias(f"_c{n}") for n, c in enumerate(cells)])
    right = sites.select(F.col(key).alias("j"), *[F.col(c).alias(f"b_{c}") for c in coordinates], *[c.alias(f"_c{n}") for n, c in enumerate(cells)])
    for n in range(len(cells)):
        left = left.withColumn(f"_c{n}", F.explode(F.array(*[F.col(f"_c{n}") + step for step in (-1, 0, 1)])))
    h = distance([F.col(f"a_{c}") for c in coordinates], [F.col(f"b_{c}") for c in coordinates])
    return left.join(right, [f"_c{n}" for n in range(len(cells))]).where("i <> j").select("i", "j", h.alias("h")).where(F.col("h") <= most)


def neighbour_distance(sites: DataFrame, k: int = 4) -> DataFrame:
    return nearest(sites, k).groupBy(F.col("i").alias("site_id")).agg(F.avg("h").alias("distance"))


def nearest_key(keys: DataFrame, wanted: DataFrame, most: int = 10_000) -> DataFrame:
    """(w1, w2, tau1, tau2): for each wanted (tau1, tau2), the stored pair that is nearest in logarithms, the smaller
    one of equally near ones.

    Up to ``most`` stored pairs are broadcast, and each is compared. More of them are searched by cells of the
    plane of logarithms, within a reach that is doubled for those that have found nothing yet."""
    log = lambda c: F.log10(F.col(c) + 1e-12)
    own = written(keys.select("tau1", "tau2").distinct().select("tau1", "tau2", log("tau1").alias("x"), log("tau2").alias("y")).withColumn("id", 2 * F.monotonically_increasing_id()))
    asked = written(wanted.select(F.col("tau1").alias("w1"), F.col("tau2").alias("w2")).distinct().select("w1", "w2", log("w1").alias("x"), log("w2").alias("y")).withColumn("id", 2 * F.monotonically_increasing_id() + 1))
    stats = own.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in XY]).first()
    best = lambda d: F.min_by(F.struct("tau1", "tau2"), F.struct(d, "tau1", "tau2")).alias("b")
    if stats["n"] <= most:
        near = F.broadcast(own.select("tau1", "tau2", F.col("x").alias("kx"), F.col("y").alias("ky")))
        d = (F.col("kx") - F.col("x")) * (F.col("kx") - F.col("x")) + (F.col("ky") - F.col("y")) * (F.col("ky") - F.col("y"))
        return asked.join(near).groupBy("w1", "w2").agg(best(d)).select("w1", "w2", "b.tau1", "b.tau2")
    reach, left, parts = 2 * max(1e-9, stats["x"], stats["y"]) / stats["n"] ** 0.5, asked, []
    while left.head(1):
        found = neighbours_within(left, own, reach, key="id").join(own.select(F.col("id").alias("j"), "tau1", "tau2"), "j")
        parts.append(written(found.groupBy("i").agg(best(F.col("h"))).select(F.col("i").alias("id"), "b.tau1", "b.tau2")))
        left, reach = written(left.join(parts[-1], "id", "left_anti")), 2 * reach
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    return asked.join(everything, "id").select("w1", "w2", "tau1", "tau2")


# ---------------------------------------------------------------- variograms


def bin_edges(sites: DataFrame, coordinates: Sequence[str] = XY) -> list[float]:
    """Up to a third of the box's diagonal, ceil(2 log2 n + 1) bins."""
    row = sites.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in coordinates]).first()
    most = float(np.sqrt(sum(float(row[c]) ** 2 for c in coordinates))) / 3
    n = int(np.ceil(2 * np.log2(max(2, row["n"])) + 1))
    return np.linspace(0, most, n + 1).tolist()


def lag_bin(h: Column, edges: Sequence[float]) -> Column:
    """From 0, half-open [lo, hi); null outside."""
    out = F.lit(None).cast("int")
    for b, (lo, hi) in enumerate(zip(edges, edges[1:])):
        out = F.when((h >= lo) & (h < hi), b).otherwise(out)
    return out


def semivariogram(panel: DataFrame, sites: DataFrame, edges: Sequence[float], value: str = "z", estimator: str = "matheron", coordinates: Sequence[str] = XY, block: int = 256, span: int = 1024, strip: int | None = None) -> DataFrame:
    """(bin, lag, gamma, n) over all pairs of sites in a bin and all times that both have.

    Sites go to strips of near ones and times to spans; every two strips meet in one task for each span and leave two sums
    a bin, so pairs of sites and times are never rows. Blocks of a strip with no pair in a bin are passed over."""
    if estimator not in ("matheron", "cressie"):
        raise ValueError("estimator is 'matheron' or 'cressie'")
    own = panel.where(F.col(value).isNotNull()).groupBy("site_id", "t").agg(F.avg(value).alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    own = written(own.join(sites.select("site_id"), "site_id", "left_semi"))
    places = strips.place_order(sites.join(own.select("site_id").distinct(), "site_id", "left_semi"), coordinates)
    index, times = written(index_of(places, ["place", "site_id"], "i").select("site_id", "i")), index_of(own, ["t"], "j")
    counts, level = (index.count(), times.count()), own.agg(F.avg("v")).first()[0]
    dealt = strips.of_panel(own, ["v"], index, times, counts, sites, coordinates, block, span, strip)
    limits = np.asarray(edges, float)
    bins = len(limits) - 1

    def sums_of(first: strips.Strip, second: strips.Strip, same: bool) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, bins))
        for a, b, own_block in strips.blocks(first, second, same, block):
            h = np.sqrt(sum((a.at[:, c, None] - b.at[None, :, c]) ** 2 for c in range(a.at.shape[1])))
            ok = (h >= limits[0]) & (h < limits[-1])
            if own_block:
                ok &= np.arange(len(a))[:, None] < np.arange(len(b))
            if not ok.any():
                continue
            s, t = a.values["seen"], b.values["seen"]
            n = s @ t.T
            ok &= n > 0
            of = np.searchsorted(limits, h[ok], side="right") - 1
            x, y = (a.values["v"] - level) * s, (b.values["v"] - level) * t
            if estimator == "matheron":
                d = np.maximum((x * x) @ t.T + s @ (y * y).T - 2 * (x @ y.T), 0)
            else:
                d = _roots(x, y, s, t)
            sums += [np.bincount(of, d[ok], bins), np.bincount(of, n[ok], bins)]
        found = np.flatnonzero(sums[1])
        yield pd.DataFrame({"bin": found.astype(np.int32), "total": sums[0][found], "n": sums[1][found].astype(np.int64)})

    parts = dealt.met(sums_of, "bin int, total double, n long")
    n = F.sum("n")
    sums = parts.groupBy("bin").agg((F.sum("total") / n).alias("m"), n.alias("n"))
    n = F.col("n").cast("double")  # the square of a count may leave 64 bits
    gamma_of = F.col("m") / 2 if estimator == "matheron" else 0.5 * F.pow("m", 4) / (0.457 + 0.494 / n + 0.045 / (n * n))
    middle = F.element_at(F.array(*[F.lit((lo + hi) / 2) for lo, hi in zip(edges, edges[1:])]), F.col("bin") + 1)
    return sums.select("bin", middle.alias("lag"), gamma_of.alias("gamma"), "n")


def _roots(x: np.ndarray, y: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For every two rows the sum of the roots of absolute differences at times that both have."""
    out, d = np.zeros((len(x), len(y))), np.empty((len(x), len(y)))
    columns = [np.ascontiguousarray(m.T) for m in (x, y, s, t)]
    for p, q, u, v in zip(*columns):
        np.subtract(p[:, None], q[None], out=d)
        np.sqrt(np.abs(d, out=d), out=d)
        if not u.all():
            d *= u[:, None]
        if not v.all():
            d *= v[None]
        out += d
    return out


def variogram_match(truth: DataFrame, predicted: DataFrame, weighted: bool = True, normalised: bool = False, eps: float = 1e-8) -> DataFrame:
    """Mean square difference of two variograms over the bins that both have, weighted by the smaller
    counts; ``normalised``: each bin's difference relative to the truth in it. No such bin: null."""
    both = truth.select("bin", F.col("gamma").alias("a"), F.col("n").alias("na")).join(predicted.select("bin", F.col("gamma").alias("b"), F.col("n").alias("nb")), "bin")
    both = both.where("a IS NOT NULL AND b IS NOT NULL AND na > 0 AND nb > 0")
    w = F.least("na", "nb").cast("double") if weighted else F.lit(1.0)
    d = F.col("a") - F.col("b")
    if normalised:
        d = d / (F.col("a") + eps)
    loss = F.sum(w * d * d) / F.sum(w)
    return both.agg(loss.alias("loss"), F.count("*").alias("bins"))


# ---------------------------------------------------------------- Matérn


def bessel_k(nu: float, x: np.ndarray) -> np.ndarray:
    """K_nu(x) for x > 0: the integral of exp(-x cosh t) cosh(nu t), by the trapezoid rule."""
    t = np.linspace(0, 20, 4001)
    f = np.exp(-np.outer(np.asarray(x, float), np.cosh(t))) * np.cosh(nu * t)
    return np.trapezoid(f, t, axis=1)


def bessel_k1_times_x(x: np.ndarray) -> np.ndarray:
    """x K_1(x), 1 at 0: the power series below 0.5, Taylor polynomials about the places of a table up to ``K1_FAR``, and
    beyond the integral that the table comes from; all are right to about 1e-13."""
    x = np.asarray(x, float)
    k = np.rint(np.clip(x, 0.5, K1_FAR) * K1_STEPS)
    u = x - k / K1_STEPS
    k = k.astype(np.intp) - K1_STEPS // 2
    terms = _k1_table()
    out = terms[-1][k]
    for c in terms[-2::-1]:
        out *= u
        out += c[k]
    low, high = x < 0.5, x >= K1_FAR
    if low.any():
        own = np.maximum(x[low], 1e-300)
        q = own * own / 4
        a, b = (np.polynomial.polynomial.polyval(q, c, tensor=False) for c in k1_series())
        out[low] = np.where(own > 1e-12, 1 + 2 * q * (np.log(own / 2) * a - b / 2), 1.0)
    if high.any():
        out[high] = _k_times_x(x[high], 1)
    return out


def _k_times_x(x: np.ndarray, nu: int) -> np.ndarray:
    """x K_nu(x), nu = 0 or 1: the integral of exp(-x cosh t) cosh(nu t) by the trapezoid rule with steps that follow the
    integrand's width."""
    x = np.asarray(x, float)
    step = 0.5 / np.sqrt(np.maximum(x, 4))
    t = step[..., None] * np.arange(1, K1_NODES + 1)
    tail = np.exp(-2 * x[..., None] * np.sinh(t / 2) ** 2) * np.cosh(nu * t)
    return x * np.exp(-x) * step * (0.5 + tail.sum(-1))


@cache
def _k1_table(order: int = 6) -> list[np.ndarray]:
    """The coefficients of g = x K_1(x) about 0.5, 0.5 + 1 / ``K1_STEPS``, ...: g and g' = -x K_0 by the integral, the
    others from x g'' = g' + x g."""
    x = 0.5 + np.arange(int((K1_FAR - 0.5) * K1_STEPS) + 2) / K1_STEPS
    fine = np.linspace(0, 12, 2401)
    by_integral = lambda nu: np.trapezoid(np.exp(-x[:, None] * (np.cosh(fine) - 1)) * np.cosh(nu * fine), fine, axis=1) * x * np.exp(-x)
    c = [by_integral(1), -by_integral(0)]
    for n in range(order - 1):
        c.append(((n + 1) * (1 - n) * c[n + 1] + x * c[n] + (c[n - 1] if n else 0)) / (x * (n + 2) * (n + 1)))
    return c


K1_STEPS, K1_FAR = 64, 64.0
K1_NODES = 18


def k1_series(terms: int = 10) -> tuple[list[float], list[float]]:
    """1 / (k! (k + 1)!), and these times psi(k + 1) + psi(k + 2)."""
    a, b, psi = [], [], -np.euler_gamma
    for k in range(terms):
        a.append(1 / (factorial(k) * factorial(k + 1)))
        b.append(a[-1] * (2 * psi + 1 / (k + 1)))
        psi += 1 / (k + 1)
    return a, [float(x) for x in b]


def matern(h: np.ndarray, nu: float, scale: float = 1.0) -> np.ndarray:
    r = np.asarray(h, float) / scale
    if nu == 1:
        return bessel_k1_times_x(r)
    out = np.ones_like(r)
    far = r >= 1e-12
    out[far] = 2 ** (1 - nu) / gamma(nu) * r[far] ** nu * bessel_k(nu, r[far])
    return out


def matern_table(nu: float, most: float, steps: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Correlations at ``steps`` + 1 distances from 0 to ``most`` in units of the scale, denser near 0."""
    r = most * (np.arange(steps + 1) / steps) ** 2
    return r, matern(r, nu)


def _correlations(sites: DataFrame, nu: float, scale: float, coordinates: Sequence[str], block: int):
    """The sites' strips, and what gives the correlations of two blocks of them."""
    stats = sites.agg(*[(F.max(c) - F.min(c)).alias(c) for c in coordinates]).first()
    far = float(np.sqrt(sum(float(stats[c] or 0) ** 2 for c in coordinates)))
    shared = sites.sparkSession.sparkContext.broadcast(None if nu == 1 else matern_table(nu, far / scale + 1e-9))

    def of(a: strips.Strip, b: strips.Strip) -> np.ndarray:
        h = np.sqrt(sum((a.at[:, c, None] - b.at[None, :, c]) ** 2 for c in range(a.at.shape[1]))) / scale
        return matern(h, nu) if shared.value is None else np.where(h < 1e-12, 1.0, cubic(h, *shared.value))

    return strips.of_sites(sites, coordinates, block), of


def matern_pairs(sites: DataFrame, nu: float = 1.0, scale: float = 0.08, coordinates: Sequence[str] = XY, block: int = 256) -> DataFrame:
    """(i, j, v): correlation of every pair of sites with i <= j. The matrix is what is asked for, so its size is
    the result's. Every two strips of sites meet in one task, block by block. For nu = 1 correlations are exact,
    else they come from a table of the function (cubic interpolation, error below 1e-7)."""
    dealt, of = _correlations(sites, nu, scale, coordinates, block)

    def run(first: strips.Strip, second: strips.Strip, same: bool) -> Iterator[pd.DataFrame]:
        for a, b, own in strips.blocks(first, second, same, block):
            i, j = (x.ravel() for x in np.broadcast_arrays(a.ids[:, None], b.ids[None]))
            keep = (i <= j) if own else np.ones(len(i), bool)
            yield pd.DataFrame({"i": np.minimum(i, j)[keep], "j": np.maximum(i, j)[keep], "v": of(a, b).ravel()[keep]})

    return dealt.met(run, "i long, j long, v double")


def matern_by_site(sites: DataFrame, nu: float = 1.0, scale: float = 0.08, coordinates: Sequence[str] = XY, block: int = 256) -> DataFrame:
    """(site_id, mean, square, nearest): of each row of the correlation matrix the mean, the sum of squares, and the
    largest correlation with another site; two strips leave one row for each of their sites, never one for each pair."""
    dealt, of = _correlations(sites, nu, scale, coordinates, block)

    def run(first: strips.Strip, second: strips.Strip, same: bool) -> Iterator[pd.DataFrame]:
        # Of both sides: total, square and nearest.
        left, right = ([np.zeros(len(x)), np.zeros(len(x)), np.full(len(x), -np.inf)] for x in (first, second))
        for i in range(0, len(first), block):
            a = first.part(i, block)
            for j in range(i if same else 0, len(second), block):
                b = second.part(j, block)
                v, own = of(a, b), same and i == j
                other = np.where(np.eye(len(a), dtype=bool), -np.inf, v) if own else v
                for side, at, axis in ((left, i, 1), (left if same else right, j, 0))[: 1 if own else 2]:
                    cut = slice(at, at + v.shape[1 - axis])
                    side[0][cut] += v.sum(axis)
                    side[1][cut] += np.einsum("ij,ij->i" if axis else "ij,ij->j", v, v)
                    side[2][cut] = np.maximum(side[2][cut], other.max(axis, initial=-np.inf))
        for x, side, n in ((first, left, len(second)), (second, right, len(first)))[: 1 if same else 2]:
            yield pd.DataFrame({"site_id": x.ids, "n": n, "total": side[0], "square": side[1], "nearest": side[2]})

    parts = dealt.met(run, "site_id long, n long, total double, square double, nearest double")
    nearest = F.max("nearest")
    return parts.groupBy("site_id").agg((F.sum("total") / F.sum("n")).alias("mean"), F.sum("square").alias("square"), F.when(nearest > float("-inf"), nearest).alias("nearest"))


def cubic(x: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Cubic interpolation through the four nearest places of a table."""
    k = np.clip(np.searchsorted(at, x) - 2, 0, len(at) - 4)
    out = np.zeros_like(x, float)
    for m in range(4):
        part = values[k + m]
        for n in range(4):
            if n != m:
                part = part * (x - at[k + n]) / (at[k + m] - at[k + n])
        out = out + part
    return out
