"""Exact top-k search by a Voronoi join: largest integer inner products.

Data and queries go to the cell of their nearest pivot; each cell is summed up by its size and radius, for
data and for queries. For a query q and a vector v of a cell with pivot p and radius r, the score q.v lies
within |q| r of q.p. Summaries alone give a bound for each group: of the data cells, only those whose
highest score with any query of the group can reach what k rows are sure to reach stay. Then, for each
query of the group: the cells with the highest lower bounds that together hold k vectors besides all of
the query's own rows give it a score that its k-th result reaches at least, and only cells whose upper
bound reaches it are searched. Data cells go to parts and query cells to blocks of bounded size; a part is copied only to the blocks with a query that needs its cell, every (part, block) is solved
by one matrix product, and the best k of all parts are merged. Parts and blocks are
filled with cells along a chain of near pivots, so queries of a block need about the same parts, and few
rows are few of both.

Bounds are computed in floating point with a margin above its error; scores are exact: products of
64-bit floats where all sums stay below 2**53, else of Python's integers.

Cases: vectors that are null or hold null or non-finite components, and rows with null vec_id, take
no part; shorter vectors count as filled up with zeros; rows that share a query's vec_id are its own;
equal rows are one query, but as candidates they stay apart (k of them, as no result holds more); ties go to the smaller vec_id; an empty
table gives an empty result; further columns are ignored. Scores outside 64 bits, of components that
no embedding has, are held at the end of that range.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import first_by_hash, materialize
from tessella.llm.vectors import as_lists, matrix, scaled, valid

RESULT = "query_id long, mark long, vec_id long, score long"


def _assign(pivots, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value.astype(np.float64)
        for batch in batches:
            v = matrix(batch["v"], width)
            x = v.astype(np.float64)
            far = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)
            cell = far.argmin(1)
            r = np.sqrt(((x - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["mark"], batch["copies"], batch["asks"], as_lists(v), pa.array(cell.astype(np.int32)), pa.array(r)], names=["vec_id", "mark", "copies", "asks", "v", "cell", "r"])

    return run


def _needed(pivots, cells, width: int, k: int):
    """For each query, the parts with cells that it has to search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value.astype(np.float64)
        size, radius, first, parts, reached = cells.value
        held = np.flatnonzero(size)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                v = matrix(batch["v"], width)
                q = v.astype(np.float64)
                norm = np.sqrt((q * q).sum(1))
                middle = q @ p[held].T
                slack = 1e-9 * (np.abs(q) @ np.abs(p[held]).T + norm[:, None] * radius[held]) + 1
                low, high = middle - norm[:, None] * radius[held] - slack, middle + norm[:, None] * radius[held] + slack
                order = np.argsort(-low, axis=1)
                enough = np.cumsum(size[held][order], axis=1) >= k + batch["own"].to_numpy()[:, None]
                least = np.where(enough.any(1), np.take_along_axis(np.take_along_axis(low, order, 1), enough.argmax(1)[:, None], 1)[:, 0], -np.inf)
                row, cell = np.nonzero((high >= least[:, None]) & reached[batch["q_cell"].to_numpy()][:, held])
                cell = held[cell]
                n = parts[cell]
                part = np.repeat(first[cell], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, part = np.unique(np.stack([np.repeat(row, n), part]), axis=1)  # cells may share a part
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch["vec_id"].take(take), batch["mark"].take(take), as_lists(v).take(take), batch["block"].take(take), pa.array(part.astype(np.int32))], names=["vec_id", "mark", "v", "block", "part"])

    return run


def reached(p: np.ndarray, size: np.ndarray, radius: np.ndarray, asking: np.ndarray, wanted: np.ndarray, k: int) -> np.ndarray:
    """For each group of queries (radius ``asking``, -1: none; ``wanted``: rows besides its queries' own),
    the data cells that may hold a result of any of its queries."""
    x = p.astype(np.float64)
    norm, q = np.sqrt((x * x).sum(1)), np.maximum(asking, 0)
    middle = x @ x.T
    spread = norm[:, None] * radius + q[:, None] * norm + q[:, None] * radius
    slack = 1e-9 * (np.abs(x) @ np.abs(x).T + spread) + 1
    low, high = middle - spread - slack, middle + spread + slack
    low[:, size == 0] = -np.inf
    order = np.argsort(-low, axis=1)
    enough = np.cumsum(size[order], axis=1) >= k + wanted[:, None]
    least = np.where(enough.any(1), np.take_along_axis(np.take_along_axis(low, order, 1), enough.argmax(1)[:, None], 1)[:, 0], -np.inf)
    return (high >= least[:, None]) & (asking >= 0)[:, None] & (size > 0)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    if q.size and v.size and float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] >= 2**53:
        return np.clip(q.astype(object) @ v.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)
    return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)


def _solve(width: int, k: int):
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        ids = data["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        qid, mark = queries["q_vec_id"].to_numpy(), queries["q_mark"].to_numpy()
        out = [np.zeros((0, 4), np.int64)]
        if len(ids) and len(qid):
            scores = products(matrix(queries["q_v"].combine_chunks(), width), matrix(data["v"].combine_chunks(), width)[order])
            for i in range(len(qid)):
                other = np.flatnonzero(ids != qid[i])
                best = other[np.argsort(-scores[i][other], kind="stable")[:k]]
                out.append(np.stack([np.full(len(best), qid[i]), np.full(len(best), mark[i]), ids[best], scores[i][best]], 1))
        rows = np.concatenate(out)
        return pa.table({n: rows[:, i] for i, n in enumerate(("query_id", "mark", "vec_id", "score"))})

    return run


def packed(p: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each cell and the number of its blocks (0: no rows). Small cells that follow each
    other on a chain of nearest pivots share a block of up to ``most`` rows."""
    first, blocks = np.zeros(len(p), np.int64), -(-rows // most)
    x = p.astype(np.float64)
    left, at, number, fill = set(np.flatnonzero(rows).tolist()), 0, 0, 0
    while left:
        names = np.array(sorted(left))
        at = int(names[((x[names] - x[at]) ** 2).sum(1).argmin()])
        left.discard(at)
        if fill and fill + rows[at] > most:
            number, fill = number + 1, 0
        first[at] = number
        fill += int(rows[at])
        if blocks[at] > 1:
            number, fill = number + int(blocks[at]), 0
    return first, blocks


def searches(vectors: DataFrame, is_query: Column, *, k: int, vector: str, scale: int, most_pivots: int, part_rows: int, block_rows: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Data (part, vec_id, v), queries with every part that each has to search (a written table), the vectors'
    width, and the number of parts times that of blocks."""
    spark = vectors.sparkSession
    base = vectors.where(F.col("vec_id").isNotNull() & valid(F.col(vector)))
    base = base.select("vec_id", scaled(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    base = base.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("copies"), F.max("asks").alias("asks"))
    base = materialize(base.withColumn("mark", F.xxhash64("v")), "vectors")
    n, width = base.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(1, width or 1)
    some = first_by_hash(base.select("vec_id", "mark", "v"), n, max(1, min(most_pivots, isqrt(n) // 2)), "vec_id", "mark").collect()
    p = np.zeros((max(1, len(some)), width), np.int64)
    for i, row in enumerate(some):
        p[i, : len(row.v)] = row.v
    pivots = spark.sparkContext.broadcast(p)

    rows = base.select("vec_id", "mark", "v", "copies", "asks")
    placed = materialize(rows.mapInArrow(_assign(pivots, width), "vec_id long, mark long, copies long, asks boolean, v array<long>, cell int, r double"), "cells")
    own = placed.groupBy("vec_id").agg(F.sum("copies").alias("own"))
    asked = materialize(placed.where("asks").select("vec_id", "mark", "v", "r", F.col("cell").alias("q_cell")).join(own, "vec_id"), "asked")

    # One row for each pivot.
    size, radius, asking, queries, wanted = (np.full(len(p), x) for x in (0, 0.0, -1.0, 0, 0))
    for cell, count, r in placed.groupBy("cell").agg(F.sum("copies"), F.max("r")).collect():
        size[cell], radius[cell] = count, r
    for cell, count, r, most in asked.groupBy("q_cell").agg(F.count("*"), F.max("r"), F.max("own")).collect():
        queries[cell], asking[cell], wanted[cell] = count, r, most
    (first, parts), (first_block, blocks) = packed(p, size, part_rows), packed(p, queries, block_rows)
    cells = spark.sparkContext.broadcast((size, radius, first, parts, reached(p, size, radius, asking, wanted, k)))

    def dealt(cell: str, first: np.ndarray, counts: np.ndarray, *by: str) -> Column:
        of = lambda x: F.element_at(F.array(*[F.lit(int(i)) for i in x]), F.col(cell) + 1)
        return (of(first) + F.pmod(F.xxhash64(*by), of(np.maximum(counts, 1)))).cast("int")

    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    data = placed.select(dealt("cell", first, parts, "vec_id", "mark", "copy").alias("part"), "vec_id", "v")
    asked = asked.withColumn("block", dealt("q_cell", first_block, blocks, "vec_id", "mark"))
    found = asked.mapInArrow(_needed(pivots, cells, width, k), "vec_id long, mark long, v array<long>, block int, part int")
    of_all = lambda first, counts: len({b for f, n in zip(first.tolist(), counts.tolist()) for b in range(f, f + n)})
    return data, materialize(found, "queries"), width, of_all(first, parts) * of_all(first_block, blocks)


PAIR = ["part", "block"]


def copied_share(vectors: DataFrame, is_query: Column, *, k: int = 10, vector: str = "embedding", scale: int = 1024, most_pivots: int = 1024, part_rows: int = 4096, block_rows: int = 2048) -> float:
    """How many of all pairs of a part and a block meet."""
    _, queries, _, pairs = searches(vectors, is_query, k=k, vector=vector, scale=scale, most_pivots=most_pivots, part_rows=part_rows, block_rows=block_rows)
    return queries.select(*PAIR).distinct().count() / max(1, pairs)


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 10, vector: str = "embedding", scale: int = 1024, most_pivots: int = 1024, part_rows: int = 4096, block_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows for each row with ``is_query``."""
    data, queries, width, _ = searches(vectors, is_query, k=k, vector=vector, scale=scale, most_pivots=most_pivots, part_rows=part_rows, block_rows=block_rows)
    wanted = queries.select(*PAIR).distinct().withColumnRenamed("part", "p")
    copies = data.join(wanted, F.col("part") == F.col("p")).select(*PAIR, "vec_id", "v")
    # Own column names, as both sides come from one table.
    asked = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    found = copies.groupBy(*PAIR).cogroup(asked.groupBy(*[f"q_{c}" for c in PAIR])).applyInArrow(_solve(width, k), RESULT)
    best = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
