"""Accuracy, interval and probability metrics as aggregate expressions.

All are sums and averages, so groups of any size are combined before the shuffle; the ROC area
orders distinct scores inside of buckets. An empty group gives null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import bce_with_logits, check_loss, number, sigmoid
from tessella.functions.storage import written


def _of(mask: Column | None, *values: Column) -> Column:
    keep = mask if mask is not None else F.lit(True)
    for v in values:
        keep = keep & number(v).isNotNull()
    return keep


def rmse(y: Column, p: Column, mask: Column | None = None) -> Column:
    return F.sqrt(F.avg(F.when(_of(mask, y, p), (y - p) * (y - p))))


def mae(y: Column, p: Column, mask: Column | None = None) -> Column:
    """With a mask, its rows count as they are; without one, only finite pairs do."""
    return F.avg(F.when(mask if mask is not None else _of(None, y, p), F.abs(y - p)))


def r2(y: Column, p: Column, mask: Column | None = None) -> Column:
    keep = mask if mask is not None else _of(None, y, p)
    own = F.when(keep, y)
    total = F.var_pop(own) * F.count(own)
    return F.when(total > 1e-12, 1 - F.sum(F.when(keep, (y - p) * (y - p))) / total)


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def site_averaged(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """rmse and mae over all rows, r2 as the mean of the sites' own; a constant site has 1 if it is
    predicted exactly, else 0."""
    e2 = (F.col(y) - F.col(p)) * (F.col(y) - F.col(p))
    sites = df.groupBy(*keys, "site_id").agg(F.count("*").alias("n"), F.sum(e2).alias("e2"), F.sum(F.abs(F.col(y) - F.col(p))).alias("e1"), (F.var_pop(y) * F.count("*")).alias("total"))
    own = F.when(F.col("total") > 0, 1 - F.col("e2") / F.col("total")).when(F.col("e2") == 0, 1.0).otherwise(0.0)
    return sites.groupBy(*keys).agg(F.sqrt(F.sum("e2") / F.sum("n")).alias("rmse"), (F.sum("e1") / F.sum("n")).alias("mae"), F.avg(own).alias("r2"))


def by_split(df: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """rmse, mae and r2 for each split and, as split 'full', over all of them: one pass with two
    grouping sets."""
    named = df.select(*keys, F.col("split").alias("_split"), F.col(y).alias("_y"), F.col(p).alias("_p"))
    sets = [[F.col(k) for k in [*keys, "_split"]], [F.col(k) for k in keys]]
    a, b = F.col("_y"), F.col("_p")
    out = named.groupingSets(sets, *[F.col(k) for k in [*keys, "_split"]]).agg(F.grouping("_split").alias("_all"), rmse(a, b).alias("rmse"), mae(a, b).alias("mae"), r2(a, b).alias("r2"))
    return out.select(*keys, F.when(F.col("_all") == 1, "full").otherwise(F.col("_split")).alias("split"), "rmse", "mae", "r2")


# ---------------------------------------------------------------- binary


def confusion(y: Column, logit: Column) -> dict[str, Column]:
    """Labels and probabilities of exactly 0.5 count as positive."""
    truth, said = y >= 0.5, sigmoid(logit) >= 0.5
    hit, false, miss = (F.count_if(c) for c in (truth & said, ~truth & said, truth & ~said))
    return {"accuracy": F.avg((truth == said).cast("double")), "f1": F.coalesce(2.0 * hit / F.nullif(2 * hit + false + miss, F.lit(0)), F.lit(0.0))}


def below(counts: DataFrame, keys: Sequence[str], score: str, value: str, name: str, bucket: int = 200_000) -> DataFrame:
    """``counts`` (one row for each key and score) with ``name``: the sum of ``value`` at the key's lower scores.

    Rows are dealt to buckets by sampled bounds of (key, score), about ``bucket`` rows each and equal scores
    together. Sums of buckets, added up over a key's buckets, are what a bucket starts with; only inside of
    a bucket are rows ordered."""
    counts = written(counts)
    parts = max(1, -(-counts.count() // bucket))
    before = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if parts == 1:
        return counts.withColumn(name, before(Window.partitionBy(*keys).orderBy(score)))
    placed = written(counts.repartitionByRange(parts, *keys, score).withColumn("_b", F.spark_partition_id()))
    start = placed.groupBy(*keys, "_b").agg(F.sum(value).alias(value))
    start = start.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_c"), before(Window.partitionBy(*keys).orderBy("_b")).alias("_start"))
    on = F.col("_b") == F.col("_c")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = before(Window.partitionBy(*keys, "_b").orderBy(score))
    return placed.withColumn("_in", inside).join(start, on).withColumn(name, F.col("_in") + F.col("_start")).select(*counts.columns, name)


def auc(df: DataFrame, keys: Sequence[str], y: str, score: str, bucket: int = 200_000) -> DataFrame:
    """Area under the ROC curve, ties counted half, 0.5 if one kind is missing. Rows are counted by
    score first; running sums over distinct scores are those of ``below``, so no group is one task."""
    counts = df.groupBy(*keys, F.col(score).alias("_score")).agg(F.count_if(F.col(y) >= 0.5).alias("_pos"), F.count_if(F.col(y) < 0.5).alias("_neg"))
    parts = below(counts, keys, "_score", "_neg", "_below", bucket)
    won = F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)
    return parts.groupBy(*keys).agg(F.coalesce(F.sum(won) / F.nullif((F.sum("_pos") * F.sum("_neg")).cast("double"), F.lit(0.0)), F.lit(0.5)).alias("auc"))


def bce(y: Column, logit: Column, mean: bool = True, clamp: float | None = None) -> Column:
    y = F.least(F.greatest(y, F.lit(clamp)), F.lit(1 - clamp)) if clamp else y
    return (F.avg if mean else F.sum)(bce_with_logits(y, logit))


def calibration_error(df: DataFrame, keys: Sequence[str], y: str, prob: str, bins: int = 15, mask: Column | None = None) -> DataFrame:
    """Expected calibration error over equal bins (lo, hi], the first closed at 0; probabilities
    outside [0, 1] are in no bin but count in the number of rows."""
    rows = df.where(_of(mask, F.col(y), F.col(prob)))
    edge = F.greatest(F.ceil(F.col(prob) * bins), F.lit(1))
    # One step up or down where the product is not on the right side of the exact edge.
    edge = F.when((edge > 1) & (F.col(prob) <= (edge - 1) / F.lit(float(bins))), edge - 1).when(F.col(prob) > edge / F.lit(float(bins)), edge + 1).otherwise(edge)
    inside = (F.col(prob) >= 0) & (F.col(prob) <= 1)
    each = rows.withColumn("_bin", F.when(inside, edge)).groupBy(*keys, "_bin").agg(F.count("*").alias("n"), F.sum(prob).alias("p"), F.sum(y).alias("o"))
    return each.groupBy(*keys).agg((F.sum(F.when(F.col("_bin").isNotNull(), F.abs(F.col("p") - F.col("o"))).otherwise(0.0)) / F.sum("n")).alias("ece"))


# ---------------------------------------------------------------- intervals and quantiles


def coverage(y: Column, lower: Column, upper: Column, mask: Column | None = None) -> Column:
    keep = _of(mask, y, lower, upper)
    return F.avg(F.when(keep, ((y >= lower) & (y <= upper)).cast("double")))


def mean_width(lower: Column, upper: Column, mask: Column | None = None) -> Column:
    return F.avg(F.when(_of(mask, lower, upper), upper - lower))


def pinball(y: Column, p: Column, level: float) -> Column:
    return F.avg(check_loss(y, p, level))


def quantile_weights(levels: Sequence[float], weighting: str = "uniform") -> list[float]:
    """Uniform, or those of the trapezoid rule; they sum to 1."""
    if weighting not in ("uniform", "trapezoidal"):
        raise ValueError("weighting is 'uniform' or 'trapezoidal'")
    k = len(levels)
    if not k:
        raise ValueError("levels are empty")
    if weighting == "uniform" or k == 1:
        return [1 / k] * k
    gaps = [b - a for a, b in zip(levels, levels[1:])]
    raw = [(a + b) / 2 for a, b in zip([0, *gaps], [*gaps, 0])]
    return [w / sum(raw) for w in raw]


def crps(y: Column, predictions: Sequence[Column], levels: Sequence[float], weighting: str = "uniform") -> Column:
    weights = quantile_weights(sorted(levels), weighting)
    ordered = [p for _, p in sorted(zip(levels, predictions), key=lambda x: x[0])]
    return 2 * F.avg(sum((w * check_loss(y, p, q) for w, p, q in zip(weights, ordered, sorted(levels))), F.lit(0.0)))


def nearest_level(levels: Sequence[float], wanted: float) -> int:
    return min(range(len(levels)), key=lambda i: (abs(levels[i] - wanted), i))


def picp(y: Column, predictions: Sequence[Column], levels: Sequence[float], alpha: float = 0.1) -> Column:
    low, high = (predictions[nearest_level(levels, q)] for q in (alpha / 2, 1 - alpha / 2))
    return F.avg(((y >= low) & (y <= high)).cast("double"))


def qice(y: Column, predictions: Sequence[Column], parts: int = 4) -> Column:
    if len(predictions) < parts + 1:
        return F.lit(None).cast("double")
    shares = [F.abs(F.avg(((y >= a) & (y <= b)).cast("double")) - 1 / parts) for a, b in zip(predictions[:parts], predictions[1:])]
    return sum(shares[1:], shares[0]) / parts


def bundle(y: Column, predictions: Sequence[Column], levels: Sequence[float]) -> list[Column]:
    """mse, mae, rmse of the middle quantile and the quantile metrics; zeros for an empty table."""
    middle = predictions[len(levels) // 2]
    found = {"mse": mse(y, middle), "mae": F.avg(F.abs(y - middle)), "rmse": F.sqrt(mse(y, middle)), "check_loss": pinball(y, middle, levels[len(levels) // 2]), "crps": crps(y, predictions, levels), "picp_90": picp(y, predictions, levels), "coverage_90": picp(y, predictions, levels), "qice": qice(y, predictions)}
    return [F.coalesce(v, F.lit(0.0)).alias(k) for k, v in found.items()]


def site_interval(df: DataFrame, keys: Sequence[str], y: str, logit: str, variance: str, z: float = 1.96) -> DataFrame:
    """Coverage and width of each site's interval for its share of positives: the mean logit with
    the standard error of its mean, through the sigmoid."""
    sites = df.groupBy(*keys, "site_id").agg(F.avg(logit).alias("m"), F.sqrt(F.avg(variance) / F.count("*")).alias("s"), F.avg(y).alias("share"))
    low, high = sigmoid(F.col("m") - z * F.col("s")), sigmoid(F.col("m") + z * F.col("s"))
    return sites.groupBy(*keys).agg(coverage(F.col("share"), low, high).alias("coverage"), mean_width(low, high).alias("width"))


def class_coverage(y: Column, low: Column, high: Column) -> Column:
    """How often the interval of the probability does not rule the true class out."""
    return F.avg(F.when(y > 0.5, high >= 0.5).otherwise(low <= 0.5).cast("double"))


# ---------------------------------------------------------------- diagnostics


def time_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    y, p, lower, upper = (F.col(c) for c in ("y_true", "y_pred", "lower", "upper"))
    return df.groupBy(*keys, "t").agg(F.count_if(_of(None, y, p)).alias("n_sites"), rmse(y, p).alias("rmse"), (100 * coverage(y, lower, upper)).alias("cp"), mean_width(lower, upper).alias("mpiw"))


def site_rows(df: DataFrame, keys: Sequence[str], sites: DataFrame | None = None) -> DataFrame:
    """Diagnostics of standardised residuals at each site; a site without values has n = 0."""
    y, p = F.col("y_true"), F.col("y_pred")
    z = F.when(_of(None, y, p, F.col("var")), (y - p) / F.sqrt(F.greatest(F.col("var"), F.lit(1e-12))))
    out = df.withColumn("_z", z).groupBy(*keys, "site_id").agg(
        F.count("_z").alias("n"), rmse(y, p).alias("rmse"), F.sqrt(F.avg("var")).alias("pred_sd"), F.avg("_z").alias("z_mean"), F.stddev_pop("_z").alias("z_sd"),
        F.sqrt(F.avg(F.col("_z") * F.col("_z"))).alias("z_rms"), F.avg(F.abs("_z")).alias("z_abs"), (100 * F.avg((F.abs("_z") <= 1.96).cast("double"))).alias("cp"),
    )
    if sites is None:
        return out
    every = sites.select("site_id").distinct().join(df.select(*keys).distinct()) if keys else sites.select("site_id").distinct()
    return every.join(out, [*keys, "site_id"], "left").fillna(0, ["n"])
