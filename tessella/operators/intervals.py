"""Prediction intervals and their calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import normal_z, sigmoid
from tessella.operators.metrics import below


def _sd(var: Column) -> Column:
    return F.sqrt(F.greatest(var, F.lit(0.0)))


def gaussian(eta: Column, var: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    z = normal_z(alpha)
    return eta - z * _sd(var), eta + z * _sd(var)


def logistic_normal(eta: Column, var: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    low, high = gaussian(eta, var, alpha)
    return sigmoid(low), sigmoid(high)


def critical_value(df: DataFrame, keys: Sequence[str], y: str, eta: str, var: str, alpha: float = 0.05, *, exact_up_to: int = 100_000, bins: int = 4096) -> DataFrame:
    """(keys..., q_hat, n): the linear-interpolated quantile of |y - eta| / sd at
    min((1 - alpha)(1 + 1 / n), 1). Groups of up to ``exact_up_to`` rows are sorted whole; above that the two
    order statistics are narrowed down first, by a histogram with ``bins`` bins for each factor e of the
    scores (however far the largest are out), and only the distinct scores of bins that hold them are ordered."""
    score = F.abs(F.col(y) - F.col(eta)) / F.greatest(_sd(F.col(var)), F.lit(1e-12))
    rows = df.select(*keys, score.alias("score")).where("score IS NOT NULL")
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    largest = sums.agg(F.max("n")).first()[0] or 0
    level = F.least(F.lit(1.0), F.lit(1 - alpha) * (1 + F.lit(1.0) / F.col("n")))
    at = level * (F.col("n") - 1)
    if largest <= exact_up_to:
        both = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("score")).alias("s"))
        low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
        q = F.get("s", low) + (F.get("s", high) - F.get("s", low)) * (at - F.floor(at))
        return both.select(*keys, q.alias("q_hat"), "n")
    sums = sums.select(*[F.col(k).alias(f"_s_{k}") for k in keys], "n")
    joined = rows.join(sums, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys]) if keys else rows.join(sums)
    binned = joined.select(*keys, "score", "n", F.floor(F.log(F.greatest("score", F.lit(1e-300))) * bins).alias("bin"), at.alias("at"))
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("m"), F.first("at").alias("at"), F.first("n").alias("n"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before).where((F.col("before") <= F.ceil("at")) & (F.col("before") + F.col("m") > F.floor("at")))
    wanted = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("bin").alias("_bin"), "before")
    near = binned.join(wanted, [F.col("bin") == F.col("_bin"), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]])
    # Equal scores are one row, so a bin of them is none that a task has to sort.
    held = near.groupBy(*keys, "bin", "score").agg(F.count("*").alias("m"), *[F.first(c).alias(c) for c in ("at", "n", "before")])
    held = below(held, [*keys, "bin"], "score", "m", "lower").withColumn("lower", F.col("lower") + F.col("before"))
    there = lambda place: F.max(F.when((F.col("lower") <= place) & (place < F.col("lower") + F.col("m")), F.col("score")))
    found = held.groupBy(*keys).agg(F.max("n").alias("n"), F.max("at").alias("at"), there(F.floor("at")).alias("a"), there(F.ceil("at")).alias("b"))
    return found.select(*keys, (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("q_hat"), "n")


def calibrated(eta: Column, var: Column, q_hat: Column | float, task: str = "regression") -> tuple[Column, Column]:
    q = q_hat if isinstance(q_hat, Column) else F.lit(float(q_hat))
    low, high = eta - q * _sd(var), eta + q * _sd(var)
    if task == "regression":
        return low, high
    if task == "binary":
        return sigmoid(low), sigmoid(high)
    raise ValueError("task is 'regression' or 'binary'")


def interval(eta: Column, var: Column, alpha: float = 0.05, task: str = "regression", q_hat: Column | float | None = None) -> tuple[Column, Column]:
    return calibrated(eta, var, normal_z(alpha) if q_hat is None else q_hat, task)
