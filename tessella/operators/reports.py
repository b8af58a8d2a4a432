"""Result tables: long records, summaries over seeds, tables of cells, rankings."""

from __future__ import annotations

from collections.abc import Sequence
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessella.functions.scalars import mean_se_text, number


def long_records(df: DataFrame, ids: Sequence[str], metrics: Sequence[str], digits: int = 6) -> DataFrame:
    """(ids..., metric, value), values rounded half to even."""
    out = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(ids), list(metrics), "metric", "value")
    return out.withColumn("value", F.bround("value", digits))


def backbone_and_stage(df: DataFrame, model: str = "model") -> DataFrame:
    """A model key is cut at its last underscore."""
    return df.withColumns({"backbone": F.regexp_extract(model, r"^(.*)_([^_]+)$", 1), "stage": F.regexp_extract(model, r"^(.*)_([^_]+)$", 2)})


def test_rows(df: DataFrame, split: str = "test") -> DataFrame:
    return df.where(F.col("split") == split) if "split" in df.columns else df


def mean_and_error(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and standard error over seeds; a single seed has error 0."""
    n = F.count(value)
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value) / F.sqrt(n), F.lit(0.0)).alias("se"), n.alias("n"))


def mean_and_deviation(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and deviation over the finite values; none: null, a single one: 0."""
    own = number(F.col(value))
    return df.groupBy(*keys).agg(F.avg(own).alias("mean"), F.when(F.count(own) > 0, F.coalesce(F.stddev_samp(own), F.lit(0.0))).alias("sd"))


def cell_table(df: DataFrame, rows: DataFrame, row_keys: Sequence[str], metrics: Sequence[str], percent: Sequence[str] = ("r2",), digits: int = 4) -> DataFrame:
    """One row for each row of ``rows`` (keys and ``place``), one cell 'mean (se)' for each metric,
    ``--`` for gaps, and the number of seeds."""
    summed = mean_and_error(df, [*row_keys, "metric"])
    scale = F.when(F.col("metric").isin(*percent), 100.0).otherwise(1.0)
    wide = summed.groupBy(*row_keys).agg(*[F.max(F.when(F.col("metric") == m, x)).alias(n) for m in metrics for x, n in ((F.col("mean") * scale, f"_m_{m}"), (F.col("se") * scale, f"_s_{m}"))])
    seeds = df.groupBy(*row_keys).agg(F.countDistinct("seed").alias("n_seeds"))
    out = rows.join(wide, list(row_keys), "left").join(seeds, list(row_keys), "left")
    cells = [mean_se_text(F.col(f"_m_{m}"), F.col(f"_s_{m}"), 2 if m in percent else digits).alias(m) for m in metrics]
    return out.select("place", *row_keys, *cells, F.coalesce("n_seeds", F.lit(0)).alias("n_seeds"))


def against_baseline(df: DataFrame, baseline: str, metrics: Sequence[str]) -> DataFrame:
    """Means for each model, and how much lower than the baseline's they are, in percent."""
    means = df.groupBy("model").agg(*[F.avg(m).alias(m) for m in metrics])
    base = means.where(F.col("model") == baseline).select(*[F.col(m).alias(f"_b_{m}") for m in metrics])
    return means.join(base).select("model", *metrics, *[(100 * (F.col(f"_b_{m}") - F.col(m)) / F.col(f"_b_{m}")).alias(f"{m}_gain") for m in metrics])


def student_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail of Student's t: the incomplete beta function, by its continued fraction."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    x, a, b = df / (df + t * t), df / 2, np.full_like(df, 0.5)
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    tiny = 1e-300
    c, d = np.ones_like(x), 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / np.where(np.abs(1 + top * d) < tiny, tiny, 1 + top * d)
            c = np.where(np.abs(1 + top / c) < tiny, tiny, 1 + top / c)
            h *= c * d
    logs = np.vectorize(lambda p, q: lgamma(p + q) - lgamma(p) - lgamma(q))(a, b)
    with np.errstate(divide="ignore"):
        front = np.exp(logs + a * np.log(x) + b * np.log1p(-x)) * h / a
    return np.where(flip, 1 - front, front)


@F.pandas_udf(DoubleType())
def _p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index).where(ok).astype("float64")
    out[ok] = student_p(t[ok].to_numpy(), df[ok].to_numpy())
    return out.astype("object").where(ok, None).astype("float64")


def paired_test(df: DataFrame, first: str, second: str, metric: str) -> DataFrame:
    """Paired t-test of two models over seeds: (n, t, p, significant)."""
    sides = [df.where(F.col("model") == m).select("seed", F.col(metric).alias(n)) for m, n in ((first, "_a"), (second, "_b"))]
    d = F.col("_a") - F.col("_b")
    one = sides[0].join(sides[1], "seed").agg(F.count("*").alias("n"), (F.avg(d) / F.nullif(F.stddev_samp(d) / F.sqrt(F.count("*")), F.lit(0.0))).alias("t"))
    return one.withColumn("p", _p_value("t", (F.col("n") - 1).cast("double"))).withColumn("significant", F.col("p") < 0.05)


def time_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("function", "model").agg(F.avg("wall_time_s").alias("mean"), F.stddev_pop("wall_time_s").alias("sd"), F.count("*").alias("n")).orderBy("function", "model")


def per_trial(df: DataFrame) -> DataFrame:
    return df.withColumn("time_per_trial", F.col("total_s") / F.col("n_trials"))


def quartiles(df: DataFrame, key: str, value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(key).agg(q.alias("_q")).select(key, *[F.col("_q")[i].alias(n) for i, n in enumerate(("q25", "median", "q75"))])


def best_of(df: DataFrame, key: str, value: str, largest: bool = True) -> DataFrame:
    """The key with the best value, the smaller key on ties."""
    order = F.col(value).desc_nulls_last() if largest else F.col(value).asc_nulls_last()
    return df.orderBy(order, key).limit(1)


def representative_seed(df: DataFrame, value: str) -> DataFrame:
    """The seed whose mean is closest (to 9 digits) to the median of all seeds' means; the smaller
    seed on ties, which an even number of seeds always has."""
    means = df.groupBy("seed").agg(F.avg(value).alias("mean"))
    middle = means.agg(F.percentile("mean", F.lit(0.5)).alias("middle"))
    return means.join(middle).agg(F.min_by("seed", F.struct(F.round(F.abs(F.col("mean") - F.col("middle")), 9), "seed")).alias("seed"))


def off_diagonal(matrix: DataFrame, level: float) -> DataFrame:
    return matrix.where("i <> j").agg(F.percentile(F.abs("v"), F.lit(level)).alias("value"))


def rank_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int = 1) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def worst(df: DataFrame, order: Sequence[Column], most: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(most)


def with_logs(trials: DataFrame) -> DataFrame:
    """Trials in order, with log10 of both penalties where the columns are missing."""
    for c in ("tau1", "tau2"):
        if f"log10_{c}" not in trials.columns:
            trials = trials.withColumn(f"log10_{c}", F.log10(F.col(c) + 1e-12))
    return trials.orderBy("seed", "trial")


def backfill(df: DataFrame, new: DataFrame, columns: Sequence[str], key: str = "seed") -> DataFrame:
    return df.drop(*columns).join(new.select(key, *columns), key, "left")


def largest_difference(a: DataFrame, b: DataFrame, columns: Sequence[str], key: str = "seed") -> DataFrame:
    other = b.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return a.join(other, key).agg(*[F.max(F.abs(F.col(c) - F.col(f"_{c}"))).alias(c) for c in columns])


def seed_counts(df: DataFrame, summary: DataFrame) -> DataFrame:
    return summary.select("seed").distinct().join(df.groupBy("seed").agg(F.count("*").alias("n")), "seed", "left").fillna(0, ["n"])


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def explained(spectrum: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative share of the eigenvalues (component, eigenvalue)."""
    whole = Window.partitionBy(*keys)
    return spectrum.withColumn("explained", F.sum("eigenvalue").over(whole.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("eigenvalue").over(whole))


def effective_rank(spectrum: DataFrame, least: float = 1e-10) -> DataFrame:
    return spectrum.agg(F.count_if(F.col("eigenvalue") > least).alias("rank"))


def components_for(spectrum: DataFrame, share: float) -> DataFrame:
    return explained(spectrum).where(F.col("explained") >= share).agg(F.min("component").alias("k"))


def selected_rank(spectrum: DataFrame, trace: float, sites: int) -> DataFrame:
    """(rank, noise): the largest L whose eigenvalue is above the mean variance left beyond it."""
    so_far = F.sum("eigenvalue").over(Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0))
    left = F.greatest(F.lit(0.0), (F.lit(float(trace)) - so_far) / F.nullif(F.lit(sites) - F.col("component"), F.lit(0)))
    rows = spectrum.withColumn("left", left).where("left IS NOT NULL AND eigenvalue > left")
    return rows.agg(F.coalesce(F.max("component"), F.lit(0)).alias("rank"), F.coalesce(F.max_by("left", "component"), F.lit(trace / sites)).alias("noise"))


def energy_means(eta: DataFrame) -> DataFrame:
    """(split, k, value): the mean over seeds of the mean square score (seed, split, k, eta)."""
    each = eta.groupBy("seed", "split", "k").agg(F.avg(F.col("eta") * F.col("eta")).alias("value"))
    return each.groupBy("split", "k").agg(F.avg("value").alias("value"))


def alignment_means(fields: DataFrame, phi: DataFrame) -> DataFrame:
    """(split, rank, value): the mean over seeds of the absolute cosine of a field (seed, split, site_id, m)
    with each column of a basis (site_id, k, phi)."""
    m, p = F.col("m"), F.col("phi")
    each = fields.join(phi, "site_id").groupBy("seed", "split", "k").agg((F.abs(F.sum(m * p)) / F.sqrt(F.sum(m * m) * F.sum(p * p))).alias("value"))
    return each.groupBy("split", F.col("k").alias("rank")).agg(F.avg("value").alias("value"))
