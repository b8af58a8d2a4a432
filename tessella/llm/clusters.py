"""Centroid clustering over subvector dictionaries: exact Lloyd rounds on integer vectors.

Each vector is cut into blocks of a few dimensions. The distinct subvectors of each block are its
dictionary (an aggregate, combined in the tasks before anything is shuffled), and a vector is stored
once as its codes. A round measures every dictionary entry against every centroid, once, and tasks
only add up these partial distances by code; sums of a cluster's vectors come from the dictionary too.
Rounds shuffle no vectors: each task leaves one sum for each cluster and dimension.

Dictionaries that tasks hold have at most ``most_entries`` subvectors, which is counted. More of them,
in blocks of one dimension as well, are not held by anyone: each batch of vectors then has
dictionaries of its own, with the same sums. All arithmetic is on whole numbers: 64-bit ones where no
distance can leave that range, else Python's.

Cases: vectors that are null, of another length, or hold null or non-finite components take no part;
rows with null vec_id do, and are the last to be starting centroids; repeated rows and vec_ids are rows
of their own (of starting centroids with equal hashes the smaller vector comes first); with fewer rows
than clusters every row starts one; ties go to the smaller cluster; an empty table gives an empty
result; further columns are ignored. Components beyond 64 bits, distances and inertias are held at the
end of that range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialize
from tessella.llm.vectors import LARGEST, SUMS, Sums, as_lists, floor_means, held, largest, matrix, scaled, valid


class Block:
    """The distinct subvectors of a block in lexicographic order, and how to find their places: prefixes are
    numbered from left to right."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries, self.steps = entries, []
        key = np.zeros(len(entries), np.int64)
        for column in entries.T:
            values = np.unique(column)
            longer = key * len(values) + np.searchsorted(values, column)
            self.steps.append((values, np.unique(longer)))
            key = np.searchsorted(self.steps[-1][1], longer)

    def codes(self, m: np.ndarray) -> np.ndarray:
        key = np.zeros(len(m), np.int64)
        for column, (values, prefixes) in zip(m.T, self.steps):
            key = np.searchsorted(prefixes, key * len(values) + np.searchsorted(values, column))
        return key.astype(np.int32)


def subvectors(vectors: DataFrame, width: int, size: int) -> DataFrame:
    """(block, sub): the distinct subvectors of ``size`` dimensions of ``v`` (the last block may be shorter)."""
    cut = F.transform(F.sequence(F.lit(0), F.lit((width - 1) // size)), lambda b: F.slice("v", b * size + 1, F.lit(size)))
    return vectors.select(F.posexplode(cut).alias("block", "sub")).distinct()


def dictionaries(vectors: DataFrame, width: int, sizes: list[int], most: int) -> list[Block] | None:
    """One for each block, for the first of ``sizes`` with at most ``most`` entries in all; None if there is none."""
    for size in sizes:
        found = materialize(subvectors(vectors, width, size), "subvectors")
        if found.count() <= most:
            blocks: list[list] = [[] for _ in range((width - 1) // size + 1)]
            for block, sub in found.collect():
                blocks[block].append(sub)
            return [Block(np.array(sorted(b), np.int64)) for b in blocks]
    return None


def _spans(width: int, size: int) -> list[slice]:
    return [slice(at, min(width, at + size)) for at in range(0, width, size)]


def partial(entries: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each dictionary entry (row) to each centroid's part of the block."""
    d = entries[:, None, :] - centroids[None, :, :]
    return (d * d).sum(-1)


def _coded(batches: Iterator[pa.RecordBatch], shared, width: int, kind: type) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, vectors, distances to all centroids) of every batch."""
    blocks, tables, centroids = shared.value
    for batch in batches:
        if not batch.num_rows:
            continue
        if blocks is None:
            v, parts = matrix(batch["v"], width).astype(kind), []
            for own in _spans(width, 2):
                entries, code = np.unique(matrix(batch["v"], width)[:, own], axis=0, return_inverse=True)
                parts.append(partial(entries.astype(kind), centroids[:, own])[code.reshape(-1)])
            yield batch, v, sum(parts)
        else:
            codes = matrix(batch["codes"], len(blocks))
            far = tables[0][codes[:, 0]]
            for i in range(1, len(blocks)):
                far = far + tables[i][codes[:, i]]
            yield batch, np.concatenate([b[codes[:, i]] for i, b in enumerate(blocks)], axis=1), far


def _sums(shared, width: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(len(shared.value[2]), width, kind)
        for _, v, far in _coded(batches, shared, width, kind):
            sums.add(far.argmin(1), v)
        yield sums.batch()

    return run


def _nearest(shared, width: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, far in _coded(batches, shared, width, kind):
            best = far.argmin(1)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(best.astype(np.int32)), held(far[np.arange(len(best)), best])], names=["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, *, k: int = 16, rounds: int = 3, seed: str = "1", vector: str = "embedding", scale: int = 64, width: int = 64, block: int = 2, most_entries: int = 200_000) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, a written table, and the centroids."""
    spark = vectors.sparkSession
    base = vectors.where(valid(F.col(vector)) & (F.size(vector) == width)).select("vec_id", scaled(F.col(vector), scale).alias("v"))
    base = materialize(base, "vectors")
    _, _, top = largest(base)
    kind = np.int64 if width * (2 * top) ** 2 <= LARGEST else object
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = np.array([r.v for r in base.orderBy(order.asc_nulls_last(), "v").limit(k).collect()], np.int64).reshape(-1, width).astype(kind)
    schema = f"vec_id {base.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], schema), centroids

    blocks = dictionaries(base, width, sorted({block, 1}, reverse=True), most_entries)
    if blocks is not None:
        known = spark.sparkContext.broadcast(blocks)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spans = _spans(width, known.value[0].entries.shape[1])
            for batch in batches:
                v = matrix(batch["v"], width)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], as_lists(np.stack([b.codes(v[:, s]) for b, s in zip(known.value, spans)], 1))], names=["vec_id", "codes"])

        base = materialize(base.mapInArrow(encode, schema.split(",")[0] + ", codes array<int>"), "codes")
        blocks = [b.entries.astype(kind) for b in blocks]

    def step() -> object:
        if blocks is None:
            return spark.sparkContext.broadcast((None, None, centroids))
        spans = _spans(width, blocks[0].shape[1])
        return spark.sparkContext.broadcast((blocks, [partial(b, centroids[:, s]) for b, s in zip(blocks, spans)], centroids))

    for _ in range(rounds):
        new = centroids.copy()
        for entry, dim, mean in floor_means(base.mapInArrow(_sums(step(), width, kind), SUMS)):
            new[entry, dim] = mean
        centroids = new
    return materialize(base.mapInArrow(_nearest(step(), width, kind), schema), "assigned"), centroids


def report(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256); options as for ``cluster``."""
    assigned, centroids = cluster(vectors, **options)
    sums = {c: int(d) for c, d in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    of = lambda x: min(x, LARGEST)
    digest = lambda c: hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()
    table = [(i, of(sums.get(i, 0)), of(sum(sums.values())), digest(c)) for i, c in enumerate(centroids)]
    table = vectors.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
