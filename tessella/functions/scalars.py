"""Scalar expressions: links, distances, losses and cell texts. All stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def number(x: Column) -> Column:
    """NaN and infinite values as null, so that averages and joins skip them."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, clamp: float = 1e-7) -> Column:
    held = F.least(F.greatest(p, F.lit(clamp)), F.lit(1 - clamp))
    return F.log(held / (1 - held))


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    if not 1 <= len(a) <= 3 or len(a) != len(b):
        raise ValueError("coordinates have 1, 2 or 3 dimensions")
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b)), F.lit(0.0)))


def residual(y: Column, mu: Column, task: str = "regression") -> Column:
    if task not in ("regression", "binary"):
        raise ValueError("task is 'regression' or 'binary'")
    return (logit(y) if task == "binary" else y) - mu


def check_loss(y: Column, prediction: Column, level: float | Column) -> Column:
    e, q = y - prediction, level if isinstance(level, Column) else F.lit(float(level))
    return F.greatest((q - 1) * e, q * e)


def bce_with_logits(y: Column, z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def normal_z(alpha: float) -> float:
    return NormalDist().inv_cdf(1 - alpha / 2)


def fusion_score(rmse: Column, gap: Column | None, p: Column | None) -> Column:
    if gap is None or p is None:
        return rmse
    return F.when(gap.isNull() | p.isNull() | (p == 0), rmse).otherwise(rmse + gap / F.nullif(p, F.lit(0)))


def mean_se_text(mean: Column, se: Column, digits: int = 4) -> Column:
    return F.when(mean.isNull(), "--").otherwise(F.format_string(f"%.{digits}f (%.{digits}f)", mean, se))


def mean_sd_text(mean: Column, sd: Column, digits: int = 4) -> Column:
    return F.when(mean.isNull(), "nan").otherwise(F.format_string(f"%.{digits}f ± %.{digits}f", mean, sd))


def minutes_text(seconds: Column) -> Column:
    return F.format_string("%dm %.1fs", F.floor(seconds / 60), seconds - 60 * F.floor(seconds / 60))


def r6(x: Column) -> Column:
    """Six digits, with exact decimal ties always upwards, so that two engines agree."""
    return F.round(x + 1e-9, 6)
