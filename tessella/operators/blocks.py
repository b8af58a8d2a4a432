"""Sums over times for every pair of sites, in blocks of sites.

Sites are packed once into strips (see ``strips``), every two of which meet in one task. With times of one span, what
is asked of a pair of blocks is formed, finished and left there, so no matrix of pairs is written. Longer panels are
packed into tiles, a block of sites by a span of times each; every two blocks meet for each span, and the spans'
matrices are added up as they are. A pair of sites becomes a row at the very end, and only if the result has such rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.storage import written
from tessella.operators import strips
from tessella.operators.panel import index_of

Arrays = dict[str, np.ndarray]
Finish = Callable[[Arrays, dict, bool], pd.DataFrame]


@dataclass
class Direct:
    """Of panels of one span: ``form``'s matrices are finished where they are made."""

    strips: strips.Strips
    form: Callable[[Arrays, Arrays], Arrays]
    size: int

    def finished(self, finish: Finish, schema: str, total: Callable[[list[pd.DataFrame]], pd.DataFrame] | None = None) -> DataFrame:
        """``total`` puts what the blocks of two strips leave into one table."""
        form, size = self.form, self.size

        def each(first: strips.Strip, second: strips.Strip, same: bool) -> Iterator[pd.DataFrame]:
            for a, b, own in strips.blocks(first, second, same, size):
                yield finish(form(a.values, b.values), {"left": a.ids, "right": b.ids, "left_at": a.at, "right_at": b.at}, own)

        def all_of(first: strips.Strip, second: strips.Strip, same: bool) -> Iterator[pd.DataFrame]:
            yield total(list(each(first, second, same)))

        return self.strips.met(all_of if total else each, schema)


@dataclass
class Blocks:
    """``pairs`` (first, second, x): stacked matrices of the blocks' sites, for first <= second; ``sites`` (sb, ids, at):
    each block's sites in order, and their coordinates if there are any."""

    pairs: DataFrame
    sites: DataFrame
    names: Sequence[str]
    size: int

    def finished(self, finish: Finish, schema: str, total: object = None) -> DataFrame:
        """``finish(matrices, row, same)`` for every two blocks; the row has left, right (ids), left_at and right_at;
        ``same``: both are one block."""
        names, size = self.names, self.size
        side = lambda block, n: self.sites.select(F.col("sb").alias(block), F.col("ids").alias(n), F.col("at").alias(f"{n}_at"))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for _, row in frame.iterrows():
                    x = np.frombuffer(row["x"]).reshape(len(names), size, size)[:, : len(row["left"]), : len(row["right"])]
                    yield finish(dict(zip(names, x)), row, row["first"] == row["second"])

        return self.pairs.join(side("first", "left"), "first").join(side("second", "right"), "second").mapInPandas(run, schema)


def pair_blocks(panel: DataFrame, values: Sequence[str], form: Callable[[Arrays, Arrays], Arrays], names: Sequence[str], sites: DataFrame | None = None, coordinates: Sequence[str] = ("x", "y"), size: int = 256, span: int = 1024, strip: int | None = None) -> Direct | Blocks:
    """``form`` gives the matrices ``names`` of two blocks' (sites x times) arrays of ``values``, with zeros where
    nothing was seen, and of ``seen``. ``sites``: their coordinates, for those who ask for them. ``strip``: sites that
    go through a task together (none: as many as fit)."""
    own = panel.groupBy("site_id", "t").agg(*[F.avg(v).alias(v) for v in values])
    for v in values:
        own = own.where(F.col(v).isNotNull())
    own = written(own)
    i, j = index_of(own, ["site_id"], "i"), index_of(own, ["t"], "j")
    counts = (i.count(), j.count())
    if counts[1] <= span:
        return Direct(strips.of_panel(own, values, i, j, counts, sites, coordinates, size, span, strip), form, size)
    known = i if sites is None else i.join(sites.select("site_id", F.array(*[F.col(c).cast("double") for c in coordinates]).alias("at")), "site_id", "left")
    known = known if sites is not None else known.withColumn("at", F.lit(None).cast("array<double>"))
    size, span = max(1, min(size, counts[0])), max(1, min(span, counts[1]))
    blocks = max(1, -(-counts[0] // size))
    listed = F.sort_array(F.collect_list(F.struct("i", "site_id", "at"))).alias("c")
    sites = written(known.withColumn("sb", F.floor(F.col("i") / size).cast("int")).groupBy("sb").agg(listed).select("sb", F.col("c.site_id").alias("ids"), F.col("c.at").alias("at")))
    cells = own.join(i, "site_id").join(j, "t").withColumns({"sb": F.floor(F.col("i") / size).cast("int"), "tb": F.floor(F.col("j") / span).cast("int")})

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((len(values) + 1, size, span))
        at = (f["i"].to_numpy() % size, f["j"].to_numpy() % span)
        for m, v in enumerate(values):
            out[m][at] = f[v]
        out[-1][at] = 1
        return pd.DataFrame({"sb": f["sb"].iloc[:1], "tb": f["tb"].iloc[:1], "x": [out.tobytes()]})

    tiles = written(cells.groupBy("sb", "tb").applyInPandas(pack, "sb int, tb int, x binary"))
    copies = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    copies = copies.withColumns({"first": F.least("sb", "other"), "second": F.greatest("sb", "other")})

    def one(f: pd.DataFrame) -> pd.DataFrame:
        a, b = int(f["first"].iloc[0]), int(f["second"].iloc[0])
        found = {sb: dict(zip([*values, "seen"], np.frombuffer(x).reshape(-1, size, span))) for sb, x in zip(f["sb"], f["x"])}
        if a not in found or b not in found:
            return pd.DataFrame({"first": [], "second": [], "salt": [], "x": []})
        made = form(found[a], found[b])
        return pd.DataFrame({"first": [a], "second": [b], "salt": [int(f["tb"].iloc[0]) % 16], "x": [np.stack([made[n] for n in names]).tobytes()]})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(f["x"].iloc[0]).copy()
        for x in f["x"].iloc[1:]:
            total += np.frombuffer(x)
        return pd.DataFrame({"first": f["first"].iloc[:1], "second": f["second"].iloc[:1], "salt": [0], "x": [total.tobytes()]})

    schema = "first int, second int, salt int, x binary"
    pairs = copies.groupBy("first", "second", "tb").applyInPandas(one, schema)
    if counts[1] > span:
        pairs = pairs.groupBy("first", "second", "salt").applyInPandas(add, schema).groupBy("first", "second").applyInPandas(add, schema)
    return Blocks(written(pairs.drop("salt")), sites, names, size)


def both_orders(left: np.ndarray, right: np.ndarray, keep: np.ndarray, columns: Arrays, swapped: Arrays | None, same: bool) -> pd.DataFrame:
    """(i, j, ...) rows of the entries with ``keep``; ``swapped``: the same columns as seen from j (None: alike). A
    block with itself has both orders already."""
    at, to = np.nonzero(keep)
    out = {"i": left[at], "j": right[to]} | {n: m[at, to] for n, m in columns.items()}
    if same:
        return pd.DataFrame(out)
    back = {"i": out["j"], "j": out["i"]} | {n: m[at, to] for n, m in (swapped or columns).items()}
    return pd.DataFrame({n: np.concatenate([out[n], back[n]]) for n in out})


def _summed(x: Arrays, y: Arrays, v: str = "v", counted: bool = True) -> Arrays:
    out = {"v": x[v] @ y[v].T, "a": x[v] @ y["seen"].T, "b": x["seen"] @ y[v].T}
    return out | {"n": x["seen"] @ y["seen"].T} if counted else out


def pair_sums(panel: DataFrame, value: str = "z", **sizes: int) -> DataFrame:
    """(i, j, v, n, a, b) for every two sites with common times: the sum of products, the number of those times,
    and the sums of either site's values over them."""
    found = pair_blocks(panel.select("site_id", "t", F.col(value).alias("v")), ["v"], _summed, ["v", "n", "a", "b"], **sizes)

    def rows(m: Arrays, row: pd.Series, same: bool) -> pd.DataFrame:
        swapped = m | {"a": m["b"], "b": m["a"]}
        return both_orders(np.asarray(row["left"]), np.asarray(row["right"]), m["n"] > 0, m, swapped, same)

    return found.finished(rows, "i long, j long, v double, n double, a double, b double").withColumn("n", F.col("n").cast("long"))


def _covariance(v: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, least: int = 2) -> np.ndarray:
    """NaN for fewer than ``least`` common times."""
    enough = n >= max(2, least)
    return np.where(enough, (v - a * b / np.maximum(n, 1)) / np.maximum(n - 1, 1), np.nan)


def _error(parts: DataFrame) -> DataFrame:
    """Relative Frobenius error from (d, s, twice): sums of squares, those of other blocks counted for both orders."""
    total = lambda c: F.sum(F.when(F.col("twice"), 2 * F.col(c)).otherwise(F.col(c)))
    return parts.agg((F.sqrt(total("d")) / (F.sqrt(total("s")) + 1e-12)).alias("error"))


def _squares(truth: np.ndarray, other: np.ndarray, same: bool) -> pd.DataFrame:
    both = np.isfinite(truth) & np.isfinite(other)
    d, s = np.where(both, other - truth, 0), np.where(both, truth, 0)
    return pd.DataFrame({"d": [float((d * d).sum())], "s": [float((s * s).sum())], "twice": [not same]})


def covariance_error(panel: DataFrame, truth: str, predicted: str, **sizes: int) -> DataFrame:
    """Relative Frobenius error of the sample covariance of one column against that of another, over the pairs of
    sites with two common times at least: no pair is ever a row."""
    level = panel.agg(F.avg(truth).alias("_a"), F.avg(predicted).alias("_b"))
    own = panel.join(level).select("site_id", "t", (F.col(truth) - F.col("_a")).alias("u"), (F.col(predicted) - F.col("_b")).alias("w"))
    names = [f"{c}{m}" for c in "uw" for m in "vab"] + ["n"]

    def form(x: Arrays, y: Arrays) -> Arrays:
        made = {c: _summed(x, y, c, c == "u") for c in "uw"}
        return {f"{c}{m}": made[c][m] for c in "uw" for m in "vab"} | {"n": made["u"]["n"]}

    def finish(m: Arrays, _row: pd.Series, same: bool) -> pd.DataFrame:
        return _squares(*[_covariance(m[f"{c}v"], m["n"], m[f"{c}a"], m[f"{c}b"]) for c in "uw"], same)

    return _error(pair_blocks(own, ["u", "w"], form, names, **sizes).finished(finish, "d double, s double, twice boolean"))


def covariance_error_against(panel: DataFrame, sites: DataFrame, correlation: Callable[[np.ndarray], np.ndarray], value: str = "z", coordinates: Sequence[str] = ("x", "y"), **sizes: int) -> DataFrame:
    """The same of a panel's covariance against a correlation of distances, at the sites that have coordinates."""
    level = panel.agg(F.avg(value).alias("_a"))
    own = panel.join(sites.select("site_id"), "site_id", "left_semi").join(level).select("site_id", "t", (F.col(value) - F.col("_a")).alias("v"))

    def finish(m: Arrays, row: pd.Series, same: bool) -> pd.DataFrame:
        a, b = (np.stack([np.asarray(x) for x in row[c]]) for c in ("left_at", "right_at"))
        h = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
        return _squares(correlation(h), _covariance(m["v"], m["n"], m["a"], m["b"]), same)

    found = pair_blocks(own, ["v"], _summed, ["v", "n", "a", "b"], sites=sites, coordinates=coordinates, **sizes)
    return _error(found.finished(finish, "d double, s double, twice boolean"))


def square_sum(panel: DataFrame, value: str = "v", **sizes: int) -> DataFrame:
    """(norm): the Frobenius norm of the matrix of sums of products over common times; no pair is ever a row."""

    def finish(m: Arrays, _row: dict, same: bool) -> pd.DataFrame:
        return pd.DataFrame({"s": [float((m["v"] * m["v"]).sum()) * (1 if same else 2)]})

    found = pair_blocks(panel.select("site_id", "t", F.col(value).alias("v")), ["v"], lambda x, y: {"v": x["v"] @ y["v"].T}, ["v"], **sizes)
    return found.finished(finish, "s double").agg(F.sqrt(F.coalesce(F.sum("s"), F.lit(0.0))).alias("norm"))


def distance_to_lower_gram(panel: DataFrame, value: str = "z", **sizes: int) -> DataFrame:
    """(distance): Frobenius distance of the sample covariance, 0 where it is not known, from the lower triangle (i >= j)
    of the sums of products; no pair is ever a row."""
    level = panel.agg(F.avg(value).alias("_level"))
    own = panel.join(level).select("site_id", "t", (F.col(value) - F.col("_level")).alias("u"), F.col(value).alias("w"))

    def form(x: Arrays, y: Arrays) -> Arrays:
        return _summed(x, y, "u") | {"w": x["w"] @ y["w"].T}

    def finish(m: Arrays, row: dict, same: bool) -> pd.DataFrame:
        left, right = np.asarray(row["left"])[:, None], np.asarray(row["right"])[None]
        c = np.nan_to_num(_covariance(m["v"], m["n"], m["a"], m["b"]))
        total = float(((c - np.where(left >= right, m["w"], 0)) ** 2).sum())
        return pd.DataFrame({"s": [total if same else total + float(((c - np.where(left <= right, m["w"], 0)) ** 2).sum())]})

    found = pair_blocks(own, ["u", "w"], form, ["v", "n", "a", "b", "w"], **sizes)
    return found.finished(finish, "s double").agg(F.coalesce(F.sqrt(F.sum("s")), F.lit(0.0)).alias("distance"))


def off_diagonal(panel: DataFrame, level: float, value: str = "z", few: int = 10_000, **sizes: int) -> DataFrame:
    """(value): the exact quantile, between neighbours in proportion, of the absolute covariances of two different sites
    with two common times at least.

    Values are counted by the leading bits of their numbers; the counts tell which of these the quantile is in, and
    the values with them are counted by more bits, until they are ``few`` or told apart. No value is kept or moved."""
    mean = panel.agg(F.avg(value).alias("_level"))
    own = panel.join(mean).select("site_id", "t", (F.col(value) - F.col("_level")).alias("v"))
    found = pair_blocks(own, ["v"], _summed, ["v", "n", "a", "b"], **sizes)

    def counted(shift: int, kept: list[int] | None, above: int) -> dict[int, int]:
        def finish(m: Arrays, _row: dict, same: bool) -> pd.DataFrame:
            v = np.abs(_covariance(m["v"], m["n"], m["a"], m["b"]))
            v = v[np.triu_indices(len(v), 1)] if same else v.ravel()
            keys = (np.ascontiguousarray(v[np.isfinite(v)]) + 0.0).view(np.int64)
            if kept is not None:
                keys = keys[np.isin(keys >> above, kept)]
            keys = keys >> shift
            if len(keys) and kept is None:
                low = keys.min()
                n = np.bincount(keys - low)
                at = np.flatnonzero(n)
                return pd.DataFrame({"key": at + low, "n": n[at]})
            at, n = np.unique(keys, return_counts=True)
            return pd.DataFrame({"key": at, "n": n})

        total = lambda frames: pd.concat(frames).groupby("key", as_index=False)["n"].sum()
        return {r.key: r.n for r in found.finished(finish, "key long, n long", total).groupBy("key").agg(F.sum("n").alias("n")).collect()}

    spark, schema = panel.sparkSession, "value double"
    counts, shift = counted(44, None, 64), 44
    every = sum(counts.values())
    if not every:
        return spark.createDataFrame([(None,)], schema)
    # A pair stands for both orders, so places in the order of all entries are halved.
    place = level * (2 * every - 1)
    ranks = [int(np.floor(place)) // 2, int(np.ceil(place)) // 2]

    def leading(rank: int, start: int, inside: dict[int, int]) -> tuple[int, int]:
        for key in sorted(inside):
            if start + inside[key] > rank:
                return key, start
            start += inside[key]
        raise ValueError("counts do not hold the rank")

    held = [leading(r, 0, counts) for r in ranks]
    while shift:
        keys, above = sorted({k for k, _ in held}), shift
        shift = 0 if sum(counts[k] for k in keys) <= few else max(0, shift - 20)
        counts = counted(shift, keys, above)
        held = [leading(r, start, {k: n for k, n in counts.items() if k >> (above - shift) == key}) for r, (key, start) in zip(ranks, held)]
    low, high = (float(np.array([k], np.int64).view(np.float64)[0]) for k, _ in held)
    return spark.createDataFrame([(float(low + (high - low) * (place - np.floor(place))),)], schema)


def binary_target(panel: DataFrame, variant: str, z: str = "z", y: str = "y", **sizes: int) -> DataFrame:
    """(i, j, v): the matrix whose leading eigenvectors are the basis for binary data, from logits and labels of a
    panel (t, site_id): variance_only and irls (of the working responses z + (y - p) / (p (1 - p) + 1e-4)) are
    centred products, full_taylor is the symmetric part of (1/2 - y)'z, and z'z / 8. Sums of products run over
    the times that both sites have, and so do the means that they are centred by."""
    if variant not in ("variance_only", "full_taylor", "irls"):
        raise ValueError("unknown variant")
    p = 1 / (1 + F.exp(-F.col(z)))
    work = F.col(z) + (F.col(y) - p) / (p * (1 - p) + 1e-4) if variant == "irls" else F.col(z)
    own = panel.select("site_id", "t", work.alias("z"), (0.5 - F.col(y)).alias("h"))

    def form(a: Arrays, b: Arrays) -> Arrays:
        if variant == "full_taylor":
            return {"m": (a["h"] @ b["z"].T + a["z"] @ b["h"].T) / 2 + a["z"] @ b["z"].T / 8, "n": a["seen"] @ b["seen"].T, "a": 0 * (a["seen"] @ b["seen"].T), "b": 0 * (a["seen"] @ b["seen"].T)}
        made = _summed(a, b, "z")
        return {"m": made["v"], "n": made["n"], "a": made["a"], "b": made["b"]}

    def finish(m: Arrays, row: pd.Series, same: bool) -> pd.DataFrame:
        v = m["m"] - m["a"] * m["b"] / np.maximum(m["n"], 1)
        return both_orders(np.asarray(row["left"]), np.asarray(row["right"]), m["n"] > 0, {"v": v}, None, same)

    return pair_blocks(own, ["z", "h"], form, ["m", "n", "a", "b"], **sizes).finished(finish, "i long, j long, v double")
