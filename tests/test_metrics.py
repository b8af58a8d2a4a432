"""Literal values."""

import math

import pytest
import numpy as np
from pyspark.sql import functions as F
from tessella.functions import scalars as S
from tessella.operators import blocks as K
from tessella.operators import boxes as B
from tessella.operators import intervals as I
from tessella.operators import metrics as M
from tessella.operators import moments as G
from tessella.operators import panel as P
from tessella.operators import reports as R

NAN = float("nan")


def frame(spark, y, p, mask=None):
    rows = list(zip(y, p, mask or [True] * len(y)))
    return spark.createDataFrame(rows, "y double, p double, m boolean")


def value(df, column):
    return df.agg(column.alias("v")).first().v


def test_rmse(spark):
    y, p, m = F.col("y"), F.col("p"), F.col("m")
    assert value(frame(spark, (0.0, 0.0, 100.0), (1.0, 1.0, 0.0), (True, True, False)), M.rmse(y, p, m)) == 1.0
    assert value(frame(spark, (1.0, NAN, 3.0), (1.0, 2.0, 3.0)), M.rmse(y, p)) == 0.0
    assert value(frame(spark, (1.0,), (2.0,), (False,)), M.rmse(y, p, m)) is None


def test_mae_and_r2(spark):
    y, p = F.col("y"), F.col("p")
    assert value(frame(spark, (0.0, NAN), (1.0, 2.0)), M.mae(y, p)) == 1.0
    assert value(frame(spark, (2.0, 2.0), (1.0, 2.0)), M.r2(y, p)) is None


def test_coverage_and_width(spark):
    df = spark.createDataFrame([(v, 0.0, 1.0) for v in (0.5, 5.0, 0.5, 5.0)], "y double, lo double, hi double")
    assert value(df, M.coverage(F.col("y"), F.col("lo"), F.col("hi"))) == 0.5
    edge = spark.createDataFrame([(0.0, 0.0, 2.0), (4.0, 0.0, 4.0)], "y double, lo double, hi double")
    assert value(edge, M.coverage(F.col("y"), F.col("lo"), F.col("hi"))) == 1.0
    assert value(edge, M.mean_width(F.col("lo"), F.col("hi"))) == 3.0


def test_calibration_error(spark):
    df = frame(spark, (0.0, 0.0, 1.0, 1.0), (0.2, 0.4, 0.7, 0.9))
    assert abs(M.calibration_error(df, [], "y", "p", bins=2).first().ece - 0.25) < 1e-12
    ones = frame(spark, (0.0,) * 5, (1.0,) * 5)
    assert M.calibration_error(ones, [], "y", "p").first().ece == 1.0
    edges = frame(spark, (0.0, 1.0, 0.0), (0.0, 1 / 3, 2.0))
    # 0 and 1/3 are in their bins; 2 is in none but counts in the denominator.
    assert abs(M.calibration_error(edges, [], "y", "p", bins=3).first().ece - abs(1 / 3 - 1) / 3) < 1e-12


def test_fusion(spark):
    df = spark.createDataFrame([(0.5, 0.1, 10.0), (0.5, 0.1, 0.0), (0.5, None, 3.0)], "r double, g double, p double")
    got = [round(r.v, 9) for r in df.select(S.fusion_score(F.col("r"), F.col("g"), F.col("p")).alias("v")).collect()]
    assert got == [0.51, 0.5, 0.5]


def test_auc_ties_and_single_class(spark):
    df = frame(spark, (0.0, 1.0, 1.0, 0.0), (0.1, 0.1, 0.9, 0.2))
    assert M.auc(df, [], "y", "p").first().auc == (0.5 + 1 + 0 + 1) / 4
    assert M.auc(frame(spark, (1.0, 1.0), (0.1, 0.2)), [], "y", "p").first().auc == 0.5


@pytest.mark.parametrize("bucket", [200_000, 40])
def test_auc_by_buckets(spark, bucket):
    """Many distinct scores with ties, two groups (one of a null key) and one class only in a third: as by ranks."""
    rng = np.random.default_rng(1)
    rows = [(k, float(rng.random() < 0.4) if k != "one" else 1.0, float(rng.integers(0, 300)) / 7) for k in ("a", None, "one") for _ in range(1500)]
    df = spark.createDataFrame(rows, "g string, y double, p double")
    got = {r.g: r.auc for r in M.auc(df, ["g"], "y", "p", bucket=bucket).collect()}
    for g in ("a", None):
        y, p = (np.array([r[i] for r in rows if r[0] == g]) for i in (1, 2))
        pos, neg = p[y > 0.5], p[y < 0.5]
        assert abs(got[g] - ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)) < 1e-12
    assert got["one"] == 0.5


def test_auc_of_a_million_scores(spark):
    df = spark.range(1_000_000).select(F.col("id").alias("i"), (F.xxhash64("id") / 1e18).alias("p"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("double").alias("y"))
    rows = df.orderBy("p").toPandas()
    rank, pos = np.arange(1, len(rows) + 1), rows["y"].to_numpy() > 0.5
    want = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert rows["p"].nunique() == len(rows) and abs(M.auc(df, [], "y", "p").first().auc - want) < 1e-9


def test_critical_value_of_equal_scores(spark):
    """The histogram's path with nearly all scores equal, as by sorting."""
    rows = [(0, float(i % 3 == 0) * 2, 0.0, 1.0) for i in range(300)] + [(1, 5.0, 0.0, 1.0)] * 50 + [(1, float(i), 0.0, 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "g int, y double, e double, v double")
    for alpha in (0.05, 0.5, 0.66, 0.9):
        a, b = (sorted(map(tuple, I.critical_value(df, ["g"], "y", "e", "v", alpha, exact_up_to=n).collect())) for n in (10_000, 5))
        assert np.allclose(a, b)


def test_covariance_error_of_a_doubled_field(spark):
    rows = [(t, s, float((t * 7 + s * 3) % 5)) for t in range(20) for s in range(4)]
    df = spark.createDataFrame(rows, "t long, site_id long, z double")
    double = df.withColumn("z", 2 * F.col("z"))
    assert abs(K.covariance_error(df.join(double.withColumnRenamed("z", "w"), ["site_id", "t"]), "z", "w").first().error - 3.0) < 1e-9
    assert [r.v for r in G.covariance_long(df.where("t = 0")).collect()] == [None] * 16


def test_critical_value_and_intervals(spark):
    df = spark.createDataFrame([(float(i), float(i), 1.0) for i in range(10)], "y double, e double, v double")
    assert I.critical_value(df, [], "y", "e", "v").first().q_hat == 0
    low, high = I.calibrated(F.lit(5.0), F.lit(4.0), 2.5)
    assert tuple(spark.range(1).select(low, high).first()) == (0.0, 10.0)
    with pytest.raises(ValueError):
        I.calibrated(F.lit(5.0), F.lit(4.0), 2.5, "other")


def test_histogram_and_exact_critical_values_agree(spark):
    rows = [(k, math.sin(i * k) * i, 0.0, 1.0 + i % 3) for k in (1, 2) for i in range(400)] + [(3, 1.0, 0.0, 1.0)] * 50
    df = spark.createDataFrame(rows, "k int, y double, e double, v double")
    a, b = ({r.k: round(r.q_hat, 9) for r in I.critical_value(df, ["k"], "y", "e", "v", exact_up_to=n, bins=16).collect()} for n in (10**6, 5))
    assert a == b


@pytest.mark.parametrize("text, boxes", [
    ("0 0 64 64;128 128 200 200", [(0, 0, 64, 64), (128, 128, 200, 200)]),
    ("[10, 20, 30, 40];[100, 200, 10, 10]", [(10, 20, 40, 60), (100, 200, 110, 210)]),
    ("0 0 64 64;garbage", [(0, 0, 64, 64)]),
    ("", []), ("[]", []), ("no_box", []), (None, []),
])
def test_boxes(spark, text, boxes):
    row = spark.createDataFrame([(text,)], "b string").select(B.parsed(F.col("b")).alias("x")).first()
    assert [tuple(b) for b in row.x] == boxes


@pytest.mark.parametrize("box, cells", [((0, 0, 10, 10), 1), ((0, 0, 65, 65), 4), ((-100, -100, 10000, 10000), 256), ((-200, -200, -100, -100), 0)])
def test_cells(spark, box, cells):
    df = spark.createDataFrame([("a", [tuple(map(float, box))])], "i string, b array<struct<xmin:double,ymin:double,xmax:double,ymax:double>>")
    assert B.covered_cells(df, "i", "b").count() == cells
    labels = B.label_map(df, "i", "b")
    assert labels.count() == 256 and labels.agg(F.sum("label")).first()[0] == cells
    assert len(B.packed_labels(labels, "i").first().labels) == 256


def test_split_sizes():
    assert P.contiguous_bounds(100, 0.7, 0.15, 0.15) == (70, 15)
    assert P.contiguous_bounds(3, 0.98, 0.01, 0.01) == (1, 1)
    assert P.truncated_bounds(100, 0.6, 0.2) == (60, 20)
    with pytest.raises(ValueError):
        P.contiguous_bounds(10, 0.5, 0.1, 0.1)


def test_scaler_round_trip(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), 4.0) for i in range(30)], "a double, b double, c double")
    for kind in ("standard", "minmax"):
        scaler = P.fit_scaler(df, ["a", "b", "c"], kind)
        scaled = P.transform(df, scaler, ["a", "b", "c"])
        back = P.inverse_transform(scaled, scaler, ["a", "b", "c"]).collect()
        assert all(abs(x - y) < 1e-9 for r, s in zip(sorted(back), sorted(df.collect())) for x, y in zip(r, s))
    with pytest.raises(ValueError):
        P.transform(df, None, ["a"])


def test_student_tail():
    # t = 2.228 with 10 degrees of freedom has p = 0.05.
    assert abs(R.student_p([2.2281388], [10.0])[0] - 0.05) < 1e-6
    assert abs(R.student_p([0.0], [5.0])[0] - 1) < 1e-9


def test_texts(spark):
    row = spark.range(1).select(S.minutes_text(F.lit(125.25)), S.mean_se_text(F.lit(None).cast("double"), F.lit(1.0)), S.mean_sd_text(F.lit(1.0), F.lit(0.5), 1)).first()
    assert tuple(row) == ("2m 5.3s", "--", "1.0 ± 0.5") or tuple(row)[1:] == ("--", "1.0 ± 0.5")
