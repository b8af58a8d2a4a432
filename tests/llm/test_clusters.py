import hashlib
import random
from math import floor, isfinite

import numpy as np
import pytest
from tessella.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, v int, codes int, distance int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5) for i, v in rows], SCHEMA)


def brute(rows, width=64, k=16, rounds=3, scale=64):
    kept = [(i, [floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and isfinite(x) for x in v)]
    kept = [(i, [max(-(2**63), min(2**63 - 1, x)) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        mine = [[] for _ in centroids]
        for _, v in kept:
            mine[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(mine, centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, c, d in found if c == j) for j in range(len(centroids))]
    of = lambda x: min(x, 2**63 - 1)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, of(d), of(inertia[c]), of(sum(of(e) for *_, e in found)), digest[c]) for i, c, d in found), key=str)


def got(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def some_rows(n=200, width=64):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 7 / 5, 0.2) for _ in range(width)]) for i in range(n)]
    rows += [(i, [0.5] * width) for i in range(n, n + 90)]
    return rows + [(7, [0.25] * width), (7, [0.25] * width), (None, [0.1] * width), (1000, None), (1001, []), (1002, [1.0] * (width - 1)), (1003, [1.0] * (width + 1)), (1004, [float("nan")] * width), (1005, [None] * width), (1006, [float("-inf")] * width)]


@pytest.mark.parametrize("options", [{}, {"block": 3}, {"most_entries": 8000}, {"most_entries": 0}])
def test_matches_brute_force(spark, options):
    """In blocks of two, of three with a shorter last one, of one, and with each batch's own dictionaries."""
    rows = some_rows()
    assert got(clusters.report(frame(spark, rows), **options)) == brute(rows)


@pytest.mark.parametrize("most", [200_000, 0])
def test_components_of_any_size(spark, most):
    rows = some_rows(60, 4) + [(2000, [1e300, -1e300, 1e12, 0.0]), (2001, [1e17, 1.0, 2.0, 3.0])]
    assert got(clusters.report(frame(spark, rows), width=4, k=5, most_entries=most)) == brute(rows, width=4, k=5)


def test_few_rows_and_empty_tables(spark):
    rows = [(3, [0.1] * 64), (5, [0.1] * 64), (5, [-0.1] * 64)]
    assert got(clusters.report(frame(spark, rows))) == brute(rows)
    for none in ([], [(1, None)]):
        assert got(clusters.report(frame(spark, none))) == []


def test_blocks_find_every_subvector():
    rng = np.random.default_rng(2)
    entries = np.unique(rng.integers(-3, 4, (400, 3)), axis=0)
    block = clusters.Block(entries)
    assert (entries[block.codes(entries[::-1])] == entries[::-1]).all()
