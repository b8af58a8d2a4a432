"""Integer vectors: which rows count, how they travel in Arrow batches, and exact sums by group."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Results outside 64 bits, of components that no embedding has, are held at the end of that range.
LARGEST = 2**63 - 1


def scaled(vector: Column, scale: int = 1024) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def valid(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, lambda x: finite(x.cast("double"))), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal length ``width``; shorter ones are filled up with zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def as_lists(m: np.ndarray) -> pa.Array:
    n, width = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(m).reshape(-1)))


def largest(vectors: DataFrame) -> tuple[int, int, int]:
    """(rows, longest vector, largest component without its sign) of integer vectors ``v``."""
    most = F.aggregate("v", F.lit(0).cast("decimal(20,0)"), lambda a, x: F.greatest(a, F.abs(x.cast("decimal(20,0)"))).cast("decimal(20,0)"))
    row = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(most)).first()
    return row[0], row[1] or 0, int(row[2] or 0)


def held(values: np.ndarray) -> pa.Array:
    """Whole numbers of any kind as 64-bit ones."""
    return pa.array(np.minimum(values, LARGEST).astype(np.int64))


class Sums:
    """Counts and sums of integer rows by group, over the batches of one task."""

    def __init__(self, groups: int, width: int, kind: type) -> None:
        self.n, self.total = np.zeros(groups, np.int64), np.zeros((groups, width), kind)

    def add(self, group: np.ndarray, m: np.ndarray) -> None:
        order = np.argsort(group, kind="stable")
        names, first = np.unique(group[order], return_index=True)
        if len(names):
            self.total[names] += np.add.reduceat(m[order].astype(self.total.dtype), first, axis=0)
            self.n += np.bincount(group, minlength=len(self.n))

    def batch(self, **more: int) -> pa.RecordBatch:
        """(entry, dim, n, total) for the groups with rows, after the columns ``more``."""
        used, width = np.flatnonzero(self.n), self.total.shape[1]
        total = pa.array([Decimal(int(x)) for x in self.total[used].reshape(-1)], pa.decimal128(38, 0))
        columns = {c: pa.array(np.full(len(used) * width, x, np.int32)) for c, x in more.items()}
        columns |= {"entry": pa.array(np.repeat(used, width).astype(np.int32)), "dim": pa.array(np.tile(np.arange(width), len(used)).astype(np.int32))}
        columns |= {"n": pa.array(np.repeat(self.n[used], width)), "total": total}
        return pa.RecordBatch.from_pydict(columns)


SUMS = "entry int, dim int, n long, total decimal(38,0)"


def floor_means(parts: DataFrame, *by: str) -> Iterator[tuple]:
    """(..., entry, dim, floor(sum / count)) of what all tasks have added up: one row for each component of an entry."""
    for *key, n, total in parts.groupBy(*by, "entry", "dim").agg(F.sum("n"), F.sum("total").cast("decimal(38,0)")).collect():
        yield *key, int(total) // n
