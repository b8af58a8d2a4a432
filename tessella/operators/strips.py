"""Every two sites, without a row for a pair on the way: strips of sites meet each other.

A strip is one row: up to some thousand sites with their ids, coordinates and packed values of a span of times. Every
two strips meet in one task, which goes through them block by block: its memory is that of two strips and a block, and
what it finds leaves it at once. A strip is copied for each other strip, so what is moved is the panel times the number
of strips, which is small while a strip's values fit a row of ``STRIP_BYTES``; nothing of the pairs' number is written."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.storage import written
from tessella.operators.panel import index_of

Arrays = dict[str, np.ndarray]
#: A strip's values at most; strips at least, where there are so many blocks, so that there are tasks enough; tasks at most.
STRIP_BYTES, LEAST_STRIPS, MOST_TASKS = 4_000_000, 24, 4096


@dataclass
class Strip:
    """``values``: sites x times, 0 where nothing was seen, and the same of ``seen``."""

    ids: np.ndarray
    at: np.ndarray | None
    values: Arrays

    def __len__(self) -> int:
        return len(self.ids)

    def part(self, first: int, size: int) -> Strip:
        cut = slice(first, first + size)
        return Strip(self.ids[cut], None if self.at is None else self.at[cut], {n: v[cut] for n, v in self.values.items()})


@dataclass
class Strips:
    """``rows`` (sb, tb, ids, at, x), written; ``count``: strips; ``spans``: of times; ``names``: what x holds."""

    rows: DataFrame
    count: int
    spans: int
    names: Sequence[str]

    def met(self, run: Callable[[Strip, Strip, bool], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
        """``run(first, second, same)`` for every two strips of each span, in both of which there is something."""
        names = self.names
        copies = self.rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(self.count - 1))))
        copies = copies.withColumns({"first": F.least("sb", "other"), "second": F.greatest("sb", "other")}).drop("other")
        tasks = max(1, min(MOST_TASKS, self.spans * self.count * (self.count + 1) // 2))
        dealt = copies.repartition(tasks, "first", "second", "tb").sortWithinPartitions("first", "second", "tb", "sb")

        def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, key = None, None
            for frame in frames:
                for row in frame.itertuples(index=False):
                    own, now = _unpacked(row, names), (row.first, row.second, row.tb)
                    if row.first == row.second:
                        yield from run(own, own, True)
                    elif held is not None and key == now:
                        yield from run(held, own, False)
                        held = None
                    else:
                        held, key = own, now

        return dealt.mapInPandas(pairs, schema)


def _unpacked(row, names: Sequence[str]) -> Strip:
    n, ids = len(row.ids), np.asarray(row.ids)
    values = {}
    if names:
        raw = np.frombuffer(row.x, np.uint8)
        times = len(raw) // (n * (8 * len(names) + 1))
        cells = n * times
        values = {v: raw[8 * m * cells : 8 * (m + 1) * cells].view(np.float64).reshape(n, times) for m, v in enumerate(names)}
        values["seen"] = raw[8 * len(names) * cells :].reshape(n, times).astype(float)
    return Strip(ids, None if row.at is None or row.at[0] is None else np.stack([np.asarray(p, float) for p in row.at]), values)


def blocks(first: Strip, second: Strip, same: bool, size: int) -> Iterator[tuple[Strip, Strip, bool]]:
    """Every two blocks of two strips; of a strip with itself, each two once."""
    for i in range(0, len(first), size):
        a = first.part(i, size)
        for j in range(i if same else 0, len(second), size):
            yield a, second.part(j, size), same and i == j


def strip_size(sites: int, site_bytes: int, block: int) -> int:
    """Whole blocks of sites."""
    least = min(LEAST_STRIPS, max(1, sites // block))
    size = min(-(-sites // least), max(1, STRIP_BYTES // max(1, site_bytes)))
    return max(1, -(-size // block) * block if size >= block else size)


def place_order(sites: DataFrame, coordinates: Sequence[str], cells: int = 32) -> DataFrame:
    """(site_id, place): a cell of a grid, for an order in which sites of a strip are near each other."""
    box = sites.agg(*[f(F.col(c).cast("double")).alias(f"_{n}_{c}") for c in coordinates for n, f in (("low", F.min), ("high", F.max))])
    at = [F.least(F.floor(cells * (F.col(c) - F.col(f"_low_{c}")) / F.nullif(F.col(f"_high_{c}") - F.col(f"_low_{c}"), F.lit(0.0))), F.lit(cells - 1)) for c in coordinates]
    number: Column = F.lit(0).cast("long")
    for c in at:
        number = number * cells + F.coalesce(c, F.lit(0))
    return sites.join(box).select("site_id", number.alias("place"))


def of_sites(sites: DataFrame, coordinates: Sequence[str], block: int) -> Strips:
    """Without values."""
    count = sites.count()
    size = strip_size(count, 8 * (len(coordinates) + 1), block)
    return Strips(_listed(index_of(sites, ["site_id"], "i"), sites, coordinates, size).withColumns({"tb": F.lit(0), "x": F.lit(None).cast("binary")}), max(1, -(-count // size)), 1, [])


def _listed(index: DataFrame, sites: DataFrame | None, coordinates: Sequence[str], size: int) -> DataFrame:
    """(sb, ids, at), written."""
    at = F.lit(None).cast("array<double>").alias("at")
    known = index.withColumn("at", at) if sites is None else index.join(sites.select("site_id", F.array(*[F.col(c).cast("double") for c in coordinates]).alias("at")), "site_id", "left")
    listed = F.sort_array(F.collect_list(F.struct("i", "site_id", "at"))).alias("c")
    return written(known.withColumn("sb", F.floor(F.col("i") / size).cast("int")).groupBy("sb").agg(listed).select("sb", F.col("c.site_id").alias("ids"), F.col("c.at").alias("at")))


def of_panel(own: DataFrame, values: Sequence[str], index: DataFrame, times: DataFrame, counts: tuple[int, int], sites: DataFrame | None, coordinates: Sequence[str], block: int, span: int, strip: int | None = None) -> Strips:
    """Of a panel (t, site_id, values) with one row for each cell; ``index`` (site_id, i) and ``times`` (t, j) number
    its ``counts`` sites and times."""
    span = max(1, min(span, counts[1]))
    size = strip or strip_size(counts[0], span * (8 * len(values) + 1), block)
    listed = _listed(index, sites, coordinates, size)
    cells = own.join(index, "site_id").join(times, "t").withColumns({"sb": F.floor(F.col("i") / size).cast("int"), "tb": F.floor(F.col("j") / span).cast("int")})
    n, steps = counts

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        sb, tb = int(f["sb"].iloc[0]), int(f["tb"].iloc[0])
        shape = (min(size, n - sb * size), min(span, steps - tb * span))
        at = (f["i"].to_numpy() % size, f["j"].to_numpy() % span)
        out = np.zeros((len(values), *shape))
        for m, v in enumerate(values):
            out[m][at] = f[v]
        seen = np.zeros(shape, np.uint8)
        seen[at] = 1
        return pd.DataFrame({"sb": [sb], "tb": [tb], "x": [out.tobytes() + seen.tobytes()]})

    packed = cells.groupBy("sb", "tb").applyInPandas(pack, "sb int, tb int, x binary")
    rows = written(packed.join(listed, "sb").select("sb", "tb", "ids", "at", "x"))
    return Strips(rows, max(1, -(-n // size)), -(-steps // span), values)
