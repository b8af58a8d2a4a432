"""Views over the driver's tables that stand for panels, sites, predictions and results, as
DataFrames and, under the same names, as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalars import r6
from tessella.operators import panel as P

LEVELS = (0.05, 0.25, 0.5, 0.75, 0.95)
OFFSETS = (-60.0, -25.0, 0.0, 25.0, 60.0)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def panel(spark: SparkSession, d: str) -> DataFrame:
    """site = user, t = day, z = mean value."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    return read(spark, d, "events").groupBy(F.col("user_id").alias("site_id"), day.alias("t")).agg(F.avg("value").alias("z"))


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """site = supplier, t = month of shipping since 1995, z = mean price."""
    t = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1995 * 12 - 1).cast("long")
    return read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("site_id"), t.alias("t")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("z"))


def sites(spark: SparkSession, d: str) -> DataFrame:
    raw = read(spark, d, "embeddings").select(F.col("vec_id").alias("site_id"), F.col("embedding")[1].cast("double").alias("x"), F.col("embedding")[2].cast("double").alias("y"))
    return P.range_scaled(raw, ["x", "y"])


def phi(spark: SparkSession, d: str, k: int = 3) -> DataFrame:
    """A long basis (site_id, k, phi) with k columns; not orthonormal."""
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("site_id"), F.posexplode(F.slice("embedding", 4, k)).alias("k", "phi"))
    return rows.select("site_id", F.col("k").cast("long").alias("k"), F.col("phi").cast("double").alias("phi"))


def split_panel(spark: SparkSession, d: str) -> DataFrame:
    own = panel(spark, d)
    return P.attach_split(own, P.split_contiguous(own))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Two predictors: the site's mean over train times, and the mean of the step before."""
    own = split_panel(spark, d)
    mean = own.where("split = 'train'").groupBy("site_id").agg(F.avg("z").alias("mu"))
    step = P.previous_step(own.groupBy("t").agg(F.avg("z").alias("z")), [], "t", "z").select("t", F.col("before").alias("prev"))
    rows = own.join(mean, "site_id", "left").join(step, "t", "left")
    both = F.explode(F.array(F.struct(F.lit("climatology").alias("model"), F.col("mu").alias("y_pred")), F.struct(F.lit("previous").alias("model"), F.col("prev").alias("y_pred"))))
    return rows.select((F.col("site_id") % 3).alias("seed"), "split", "site_id", "t", F.col("z").alias("y_true"), both.alias("m")).select("seed", "m.model", "split", "site_id", "t", "y_true", "m.y_pred")


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of the site means with variance and 95 % bounds from train times."""
    own = split_panel(spark, d)
    stats = own.where("split = 'train'").groupBy("site_id").agg(F.avg("z").alias("y_pred"), F.var_samp("z").alias("var"))
    rows = own.join(stats, "site_id").select((F.col("site_id") % 3).alias("seed"), F.lit("climatology").alias("method"), "split", "site_id", "t", F.col("z").alias("y_true"), "y_pred", "var")
    half = 1.96 * F.sqrt("var")
    return rows.withColumns({"lower": F.col("y_pred") - half, "upper": F.col("y_pred") + half})


def binary(spark: SparkSession, d: str) -> DataFrame:
    z = 0.5 + 4 * F.col("l_discount") - F.col("l_quantity") / 40
    return read(spark, d, "lineitem").select((F.col("l_orderkey") % 3).alias("seed"), F.col("l_suppkey").alias("site_id"), (F.col("l_returnflag") == "R").cast("double").alias("y"), z.alias("z"), (1 / (1 + F.exp(-z))).alias("p"), (F.col("l_tax") + 0.01).alias("var"))


def binary_panel(spark: SparkSession, d: str) -> DataFrame:
    """site = supplier, t = month of shipping, y = whether half of the lines or more are returned, z = mean logit."""
    z = 0.5 + 4 * F.col("l_discount") - F.col("l_quantity") / 40
    t = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1995 * 12 - 1).cast("long")
    label = F.avg((F.col("l_returnflag") == "R").cast("double")) >= 0.5
    return read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("site_id"), t.alias("t")).agg(label.cast("double").alias("y"), F.avg(z).alias("z"))


def quantile_predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).where("model = 'climatology' AND y_pred IS NOT NULL")
    return rows.select("seed", "y_true", *[(F.col("y_pred") + o).alias(f"q{i}") for i, o in enumerate(OFFSETS)])


def annotations(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem")
    x, y, w = (F.col("l_partkey") % 1024).cast("string"), (F.col("l_suppkey") * 7 % 1024).cast("string"), F.col("l_quantity").cast("long").cast("string")
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 7
    sized = F.concat(F.lit("["), x, F.lit(", "), y, F.lit(", "), w, F.lit(", "), w, F.lit("]"))
    corners = F.concat_ws(" ", x, y, ((F.col("l_partkey") % 1024) + 70).cast("string"), ((F.col("l_suppkey") * 7 % 1024) + 40).cast("string"))
    text = F.when(kind == 0, "").when(kind == 1, "no_box").when(kind == 2, "garbage").when(kind == 3, F.lit(None)).when(kind == 4, sized).otherwise(corners)
    suffix = F.when(F.col("l_orderkey") % 2 == 0, ".jpg").otherwise(".png")
    return rows.select(F.concat((F.col("l_orderkey") % 500).cast("string"), suffix).alias("image_id"), text.alias("bbox"))


def trials(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").groupBy((F.col("o_orderkey") % 10).alias("seed"), (F.floor(F.col("o_orderkey") / 10) % 50).cast("long").alias("trial"))
    out = rows.agg(F.avg("o_totalprice").alias("a"), F.min("o_totalprice").alias("b"), F.max("o_totalprice").alias("c"))
    return out.select("seed", "trial", ((F.col("trial") % 5 + 1) * 10.0).alias("tau1"), ((F.col("trial") % 3 + 1) * 0.5).alias("tau2"), (F.col("a") / 1e5).alias("rmse"), (F.col("b") / 1e4).alias("covfrob"), (F.col("c") / 1e6).alias("sv_score"))


def results(spark: SparkSession, d: str) -> DataFrame:
    """(experiment, seed, model, split, metric, value)"""
    rows = read(spark, d, "orders")
    key = F.col("o_orderkey")
    model = F.concat(F.when(key % 3 == 0, "res_net").otherwise("vit"), F.lit("_"), F.when(key % 2 == 0, "base").otherwise("full"))
    metric = F.when(key % 4 == 0, "rmse").when(key % 4 == 1, "mae").when(key % 4 == 2, "r2").otherwise("mpiw")
    split = F.when(key % 5 == 0, "val").otherwise("test")
    return rows.groupBy(F.lit("demo").alias("experiment"), (F.floor(key / 7) % 10).cast("long").alias("seed"), model.alias("model"), split.alias("split"), metric.alias("metric")).agg((F.avg("o_totalprice") / 1e5).alias("value"))


def linear_model():
    """A frozen model for batch scoring."""
    return lambda x: 2 * x[:, 0] - x[:, 1] + 1


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(f"`{n}`")).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


SQL = {
    "panel": "SELECT user_id AS site_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS t, avg(value) AS z FROM events GROUP BY ALL",
    "monthly": "SELECT l_suppkey AS site_id, (year(l_shipdate) * 12 + month(l_shipdate) - 1995 * 12 - 1)::BIGINT AS t, avg(l_extendedprice / l_quantity) AS z FROM lineitem GROUP BY ALL",
    "sites": "SELECT vec_id AS site_id, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER () + 1e-12) AS x, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER () + 1e-12) AS y FROM (SELECT vec_id, embedding[2]::DOUBLE AS x, embedding[3]::DOUBLE AS y FROM embeddings)",
    "phi": "SELECT vec_id AS site_id, k, embedding[4 + k]::DOUBLE AS phi FROM embeddings, (SELECT unnest([0, 1, 2])::BIGINT AS k)",
    "times": "SELECT t, row_number() OVER (ORDER BY t) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM panel)",
    "splits": "SELECT t, CASE WHEN k < nt THEN 'train' WHEN k < nt + least(greatest(1, round_even(n * 0.15::DOUBLE, 0)), n - nt - 1) THEN 'val' ELSE 'test' END AS split FROM (SELECT t, k, n, least(greatest(1, round_even(n * 0.7::DOUBLE, 0)), n - 2) AS nt FROM times)",
    "split_panel": "SELECT p.*, split FROM panel p JOIN splits USING (t)",
    "scored": "SELECT site_id % 3 AS seed, model, split, site_id, t, z AS y_true, CASE WHEN model = 'climatology' THEN mu ELSE prev END AS y_pred FROM split_panel LEFT JOIN (SELECT site_id, avg(z) AS mu FROM split_panel WHERE split = 'train' GROUP BY site_id) USING (site_id) LEFT JOIN (SELECT t, lag(z) OVER (ORDER BY t) AS prev FROM (SELECT t, avg(z) AS z FROM panel GROUP BY t)) USING (t), (SELECT unnest(['climatology', 'previous']) AS model)",
    "intervals": "SELECT site_id % 3 AS seed, 'climatology' AS method, split, site_id, t, z AS y_true, y_pred, var, y_pred - 1.96 * sqrt(var) AS lower, y_pred + 1.96 * sqrt(var) AS upper FROM split_panel JOIN (SELECT site_id, avg(z) AS y_pred, var_samp(z) AS var FROM split_panel WHERE split = 'train' GROUP BY site_id) USING (site_id)",
    "bin": "SELECT l_orderkey % 3 AS seed, l_suppkey AS site_id, (l_returnflag = 'R')::INT::DOUBLE AS y, 0.5 + 4 * l_discount - l_quantity / 40 AS z, 1 / (1 + exp(-(0.5 + 4 * l_discount - l_quantity / 40))) AS p, l_tax + 0.01 AS var FROM lineitem",
    "bin_panel": "SELECT l_suppkey AS site_id, (year(l_shipdate) * 12 + month(l_shipdate) - 1995 * 12 - 1)::BIGINT AS t, (avg((l_returnflag = 'R')::INT::DOUBLE) >= 0.5)::INT::DOUBLE AS y, avg(0.5 + 4 * l_discount - l_quantity / 40) AS z FROM lineitem GROUP BY ALL",
    "quant": "SELECT seed, y_true, y_pred - 60 AS q0, y_pred - 25 AS q1, y_pred AS q2, y_pred + 25 AS q3, y_pred + 60 AS q4 FROM scored WHERE model = 'climatology' AND y_pred IS NOT NULL",
    "ann": "SELECT (l_orderkey % 500)::VARCHAR || CASE WHEN l_orderkey % 2 = 0 THEN '.jpg' ELSE '.png' END AS image_id, CASE (l_orderkey + l_linenumber) % 7 WHEN 0 THEN '' WHEN 1 THEN 'no_box' WHEN 2 THEN 'garbage' WHEN 3 THEN NULL WHEN 4 THEN '[' || x || ', ' || y || ', ' || w || ', ' || w || ']' ELSE x || ' ' || y || ' ' || (x + 70) || ' ' || (y + 40) END AS bbox FROM (SELECT *, l_partkey % 1024 AS x, l_suppkey * 7 % 1024 AS y, l_quantity::BIGINT AS w FROM lineitem)",
    "keyed": "SELECT DISTINCT regexp_replace(image_id, '\\.(jpg|png)$', '') AS image_id FROM ann",
    "boxed": "SELECT DISTINCT regexp_replace(image_id, '\\.(jpg|png)$', '') AS image_id, x::DOUBLE AS xmin, y::DOUBLE AS ymin, CASE WHEN kind = 4 THEN x + w ELSE x + 70 END::DOUBLE AS xmax, CASE WHEN kind = 4 THEN y + w ELSE y + 40 END::DOUBLE AS ymax FROM (SELECT (l_orderkey % 500)::VARCHAR AS image_id, (l_orderkey + l_linenumber) % 7 AS kind, l_partkey % 1024 AS x, l_suppkey * 7 % 1024 AS y, l_quantity::BIGINT AS w FROM lineitem) WHERE kind >= 4",
    "cells": "SELECT DISTINCT image_id, r, c FROM (SELECT image_id, unnest(range(greatest(0, floor(ymin / 64))::INT, least(16, ceil(ymax / 64))::INT)) AS r, xmin, xmax FROM boxed), LATERAL (SELECT unnest(range(greatest(0, floor(xmin / 64))::INT, least(16, ceil(xmax / 64))::INT)) AS c)",
    "trials": "SELECT seed, trial, (trial % 5 + 1) * 10.0::DOUBLE AS tau1, (trial % 3 + 1) * 0.5::DOUBLE AS tau2, a / 1e5 AS rmse, b / 1e4 AS covfrob, c / 1e6 AS sv_score FROM (SELECT o_orderkey % 10 AS seed, (o_orderkey // 10) % 50 AS trial, avg(o_totalprice) AS a, min(o_totalprice) AS b, max(o_totalprice) AS c FROM orders GROUP BY ALL)",
    "results": "SELECT 'demo' AS experiment, (o_orderkey // 7) % 10 AS seed, (CASE WHEN o_orderkey % 3 = 0 THEN 'res_net' ELSE 'vit' END) || '_' || (CASE WHEN o_orderkey % 2 = 0 THEN 'base' ELSE 'full' END) AS model, CASE WHEN o_orderkey % 5 = 0 THEN 'val' ELSE 'test' END AS split, CASE o_orderkey % 4 WHEN 0 THEN 'rmse' WHEN 1 THEN 'mae' WHEN 2 THEN 'r2' ELSE 'mpiw' END AS metric, avg(o_totalprice) / 1e5 AS value FROM orders GROUP BY ALL",
}
NEEDS = {"times": ["panel"], "splits": ["times"], "split_panel": ["splits"], "scored": ["split_panel"], "intervals": ["split_panel"], "quant": ["scored"], "cells": ["boxed"], "keyed": ["ann"]}


def oracle(body: str, views: str = "", doubles: str = "") -> str:
    """``body`` after the views it needs; the columns named in ``doubles`` are rounded."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for v in views.split():
        add(v)
    if doubles:
        body = f"SELECT * REPLACE ({', '.join(f'round({c} + 1e-9, 6) AS {c}' for c in doubles.split())}) FROM ({body})"
    return (f"WITH {', '.join(f'{v} AS ({SQL[v]})' for v in order)} " if order else "") + body
