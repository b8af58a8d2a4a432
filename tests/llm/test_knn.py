import random
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessella.llm import knn

SCHEMA = "vec_id long, embedding array<double>, label int, cell int, v int"


def brute(rows, k):
    ok = [(i, [floor(x * 1024) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    out = set()
    for q, v in ok:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("part_rows, block_rows, k", [(4096, 2048, 10), (16, 2, 3)])
def test_matches_brute_force(spark, part_rows, block_rows, k):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(i % 5, 0.1) for _ in range(6)]) for i in range(300)]
    rows += [(i, [1.0] * 6) for i in range(300, 360)] + [(400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 6), (404, [float("inf")]), (405, [2.0]), (None, [1.0] * 6), (420, [1e6, -1e6, 1.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA)
    got = knn.top_k(frame, F.col("vec_id") % 20 == 0, k=k, part_rows=part_rows, block_rows=block_rows).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == brute(rows, k)


def test_empty_and_tiny_tables(spark):
    assert knn.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1, 1, 1)], SCHEMA)
    assert knn.top_k(one, F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_ids_match_brute_force(spark):
    """A query id with many rows in one tight cell, equal ones and different ones."""
    rng = random.Random(2)
    rows = [(i, [rng.gauss(i % 5, 0.1) for _ in range(6)]) for i in range(300)]
    rows += [(20, [50.0 + rng.gauss(0, 0.01) for _ in range(6)]) for _ in range(40)] + [(40, [60.0] * 6)] * 50 + [(7, [30.0] * 6)] * 30
    frame = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA)
    got = sorted(map(tuple, knn.top_k(frame, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()))
    want = []
    ok = [(i, [floor(x * 1024) for x in v]) for i, v in rows]
    for q, v in {(q, tuple(v)) for q, v in ok if q % 20 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:10])]
    assert got == sorted(want)


def test_queries_of_a_block_need_few_cells(spark):
    """Four clusters far apart in direction: a block meets its own cluster's parts, not all of them."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        middle = [0.0] * 4
        middle[i // 20 % 4] = 10.0
        rows.append((i, [m + rng.gauss(0, 0.02) for m in middle], 1, 2, 3))
    frame = spark.createDataFrame(rows, SCHEMA)
    assert knn.copied_share(frame, F.col("vec_id") % 20 == 0, k=3, block_rows=20, part_rows=400) < 0.5
    got = {tuple(r) for r in knn.top_k(frame, F.col("vec_id") % 20 == 0, k=3, block_rows=20, part_rows=400).collect()}
    assert got == brute([(i, v) for i, v, *_ in rows], 3)


def test_packed_blocks():
    rng = np.random.default_rng(1)
    p, queries = rng.integers(0, 100, (60, 3)), rng.integers(0, 30, 60)
    queries[[3, 9]] = 250, 0
    first, blocks = knn.packed(p, queries, 100)
    held = {}
    for f, b, n in zip(first.tolist(), blocks.tolist(), queries.tolist()):
        for i in range(b):
            held[f + i] = held.get(f + i, 0) + n / b
    assert max(held.values()) <= 100 and sum(held.values()) == queries.sum() and len(held) < 20
