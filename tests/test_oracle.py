"""Every panel query with SQL, in Spark and in DuckDB, over the smallest tables."""

import math

import duckdb
import pytest
from tessella.plans import queries as Q

DIR = "/root/testdata/sf0.001"
TABLES = "events lineitem orders embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v) + 0.0:.6g}"
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_matches_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, DIR)
    cursor = duck.execute(Q.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(tuple(cell(r[columns.index(c)]) for c in order) for r in cursor.fetchall())
    got = sorted(tuple(cell(r[c]) for c in order) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, DIR).count() > 0


def test_patch_scores_of_one_kind_of_label(spark, tmp_path):
    """No image has a box, so no cell is labelled: the area is 0.5 in both engines."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT k AS l_orderkey, 7 - (k % 7) + k % 4 AS l_linenumber, k AS l_partkey, k AS l_suppkey, 5.0::DOUBLE AS l_quantity FROM (SELECT unnest(range(40)) AS k)) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    name = "workload_patch_scores"
    rows = con.execute(f"SELECT split, cells, accuracy, f1, ece, auc FROM ({Q.ORACLE[name]})").fetchall()
    got = Q.QUERIES[name](spark, str(tmp_path)).select("split", "cells", "accuracy", "f1", "ece", "auc").collect()
    assert len(got) == 3 and all(r.auc == 0.5 for r in got)
    assert sorted(tuple(map(cell, r)) for r in got) == sorted(tuple(map(cell, r)) for r in rows)
