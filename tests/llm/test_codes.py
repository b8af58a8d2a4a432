import hashlib
import random
from collections import defaultdict
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessella.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code int, none int, key int, n int, error int"
TOP = 2**63 - 1


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, 3, 4, 5) for i, v, label in rows], SCHEMA)


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [max(-TOP - 1, min(TOP, floor(1024 * x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    size = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    kept = [(i, v + [0] * (size * parts - len(v)), label) for i, v, label in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for c in cut:
                mine[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(mine[j]) for x in zip(*mine[j])] if mine[j] else e for j, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found, by = [], defaultdict(int)
    for (i, _, label), c in zip(kept, cut):
        best = [nearest(x, b) for x, b in zip(c, books)]
        error = min(TOP, sum(d for d, _ in best))
        by[label] += error
        found.append((i, "".join(f"{j:02x}" for _, j in best), error, label))
    return sorted(((i, code, e, min(TOP, by[label]), digest) for i, code, e, label in found), key=str)


def got(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def some_rows(n=150, width=8):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 5, 0.5) for _ in range(width)], [None, 0, 1, 2][i % 4]) for i in range(n)]
    rows += [(i, [1.0] * width, 9) for i in range(n, n + 100)]
    return rows + [(3, [2.0] * width, 0), (3, [2.0] * width, 0), (None, [3.0] * width, None), (600, None, 1), (601, [None] * width, 1), (602, [float("nan")] * width, 1), (603, [float("inf")] * width, 1), (604, [], 1), (605, [1.5] * 3, 1)]


@pytest.mark.parametrize("entries", [256, 16])
def test_matches_brute_force(spark, entries):
    rows = some_rows()
    assert got(codes.report(frame(spark, rows), entries=entries)) == brute(rows, entries=entries)


def test_components_of_any_size(spark):
    rows = some_rows(40) + [(900, [1e300, -1e300] * 4, 5), (901, [1e12, 3.0] * 4, 5), (902, [1e17] * 8, 5)]
    assert got(codes.report(frame(spark, rows), entries=20)) == brute(rows, entries=20)


def test_few_rows_and_empty_tables(spark):
    rows = [(4, [0.5], 1), (2, [0.25, 1.0], None)]
    assert got(codes.report(frame(spark, rows))) == brute(rows)
    for none in ([], [(1, None, 1)]):
        assert got(codes.report(frame(spark, none))) == []


def test_search_agrees_with_all_distances_and_skips_far_entries():
    rng = np.random.default_rng(1)
    middles = rng.integers(-4000, 4000, (16, 6))
    book = (middles[np.arange(256) % 16] + rng.integers(-40, 40, (256, 6))).astype(float)
    x = (middles[np.arange(3000) % 16] + rng.integers(-40, 40, (3000, 6))).astype(float)
    finder = codes.Orchard(book)
    best, far = finder.nearest(x)
    every = ((x[:, None, :] - book[None]) ** 2).sum(-1)
    assert (best == every.argmin(1)).all() and (far == every.min(1)).all()
    assert finder.measured < 0.4 * every.size


def test_round_trip(spark):
    """Decoded vectors are as far from the true ones as the errors say, and nearer than the mean vector is."""
    base = codes.integers(frame(spark, some_rows()[:250]))
    books = codes.train(base, entries=16)
    out = codes.decode(codes.encode(base, books), books).withColumnRenamed("vec_id", "id").join(base.select(F.col("vec_id").alias("id"), "v"), "id")
    rows = out.collect()
    for r in rows:
        assert sum((a - b) ** 2 for a, b in zip(r.v, r.approximate)) == r.error
    v = np.array([r.v for r in rows], float)
    assert sum(r.error for r in rows) < 0.2 * ((v - v.mean(0)) ** 2).sum()
