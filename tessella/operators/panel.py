"""Panels in long form (site_id, t, z, ...): indices, splits, samples, scaling and reshaping.

Statistics are small aggregates; they go back to the rows by joins on their keys (or on nothing, for
one-row tables), and Spark broadcasts them where their measured size allows it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import number

# ---------------------------------------------------------------- indices


def drop_non_finite(panel: DataFrame, column: str = "z") -> DataFrame:
    return panel.where(number(F.col(column)).isNotNull())


def index_of(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The distinct keys, numbered from 0 in their order. One row for each time or site, so the
    window over all of them sees the small table only."""
    return df.select(*keys).distinct().withColumn(name, F.row_number().over(Window.orderBy(*keys)) - 1)


def with_index(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return df.join(index_of(df, keys, name), list(keys))


def keep_last(panel: DataFrame, steps: int, t: str = "t") -> DataFrame:
    """The last ``steps`` times, numbered anew from 0."""
    times = index_of(panel, [t], "_k").withColumn("_n", F.count("*").over(Window.partitionBy()))
    if steps < 1:
        raise ValueError("steps is at least 1")
    kept = times.where(F.col("_k") >= F.col("_n") - steps).select(t, (F.col("_k") - F.col("_n") + F.least(F.col("_n"), F.lit(steps))).alias("_new"))
    return panel.join(kept, t).drop(t).withColumnRenamed("_new", t)


def sites_seen(panel: DataFrame) -> DataFrame:
    return panel.agg(F.countDistinct("site_id").alias("sites"), F.countDistinct("t").alias("times"), F.count("*").alias("cells"))


# ---------------------------------------------------------------- splits and samples


def contiguous_bounds(n: int, train: float, val: float, test: float) -> tuple[int, int]:
    """Sizes of train and val: rounded half to even, each part at least 1."""
    if abs(train + val + test - 1) > 1e-6:
        raise ValueError("ratios must sum to 1")
    if n < 3:
        raise ValueError("three parts need three times at least")
    n_train = min(max(1, round(n * train)), n - 2)
    return n_train, min(max(1, round(n * val)), n - n_train - 1)


def truncated_bounds(n: int, train: float, val: float) -> tuple[int, int]:
    return int(n * train), int(n * val)


def split_table(panel: DataFrame, bounds, t: str = "t") -> DataFrame:
    """(t, split); ``bounds``: number of times to (train, val)."""
    times = index_of(panel, [t], "_k")
    n_train, n_val = bounds(times.count())
    return times.select(t, F.when(F.col("_k") < n_train, "train").when(F.col("_k") < n_train + n_val, "val").otherwise("test").alias("split"))


def split_contiguous(panel: DataFrame, train: float = 0.7, val: float = 0.15, test: float = 0.15, t: str = "t") -> DataFrame:
    return split_table(panel, lambda n: contiguous_bounds(n, train, val, test), t)


def split_truncated(panel: DataFrame, train: float = 0.7, val: float = 0.15, t: str = "t") -> DataFrame:
    return split_table(panel, lambda n: truncated_bounds(n, train, val), t)


def attach_split(panel: DataFrame, splits: DataFrame, t: str = "t") -> DataFrame:
    return panel.join(splits, t)


def of_split(panel: DataFrame, *names: str) -> DataFrame:
    return panel.where(F.col("split").isin(*names))


def only(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def without(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")


def draw(entities: DataFrame, key: str, seed: int) -> DataFrame:
    """The distinct entities in a seeded order: (key, place from 0, n). Two engines draw alike.

    Entities are ordered inside buckets of the hash's first four digits, and only the 65,536 counts of buckets
    are added up in one task."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    every = entities.select(key).distinct().withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, 4))
    counts = every.groupBy("_bucket").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_bucket", F.coalesce(before, F.lit(0)).alias("_start"), F.sum("m").over(Window.partitionBy()).alias("n"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_order", key)) - 1
    return every.withColumn("_inside", inside).join(starts, "_bucket").select(key, (F.col("_start") + F.col("_inside")).alias("place"), "n")


def sample_sites(panel: DataFrame, keep: float, seed: int, site: str = "site_id") -> DataFrame:
    """All times of a fixed share of the sites (at least one)."""
    drawn = draw(panel, site, seed).where(F.col("place") < F.greatest(F.lit(1), F.least(F.col("n"), F.bround(F.col("n") * keep, 0))))
    return only(panel, drawn, [site])


def held_out_sites(panel: DataFrame, share: float, seed: int, site: str = "site_id", clamp: bool = True) -> DataFrame:
    """The held-out sites; with ``clamp``, at least one site is held out and one is left."""
    count = F.bround(F.col("n") * share, 0)
    if clamp:
        count = F.greatest(F.lit(1), F.least(F.col("n") - 1, count))
    return draw(panel, site, seed).where(F.col("place") < count).select(site)


def split_sites(panel: DataFrame, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(observed, held-out) rows."""
    held = held_out_sites(panel, share, seed)
    return without(panel, held, ["site_id"]), only(panel, held, ["site_id"])


def nested_roles(panel: DataFrame, share: float, seed: int) -> DataFrame:
    """A ``role`` for each row of a split panel: fit, calibrate (held-out, val), score (held-out,
    test) or hidden (held-out, train)."""
    held = held_out_sites(panel, share, seed, clamp=False).withColumn("held", F.lit(True))
    rows = panel.join(held, "site_id", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    role = F.when(~F.col("held"), "fit").when(F.col("split") == "val", "calibrate").when(F.col("split") == "test", "score").otherwise("hidden")
    return rows.withColumn("role", role)


def split_entities(df: DataFrame, key: str, train: float, val: float, seed: int) -> DataFrame:
    """(key, split) by a seeded order, sizes cut to whole numbers."""
    n_train, n_val = F.floor(F.col("n") * train), F.floor(F.col("n") * val)
    split = F.when(F.col("place") < n_train, "train").when(F.col("place") < n_train + n_val, "val").otherwise("test")
    return draw(df, key, seed).select(key, split.alias("split"))


def at_most(df: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    return only(df, draw(df, key, seed).where(F.col("place") < most), [key])


# ---------------------------------------------------------------- scaling


def range_scaled(df: DataFrame, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """(x - min) / (max - min + 1e-12); the range is that of the rows with ``where``."""
    seen = df.where(where) if where is not None else df
    stats = seen.agg(*[f(c).alias(f"_{f.__name__}_{c}") for c in columns for f in (F.min, F.max)])
    rows = df.join(stats)
    out = {c: (F.col(c) - F.col(f"_min_{c}")) / (F.col(f"_max_{c}") - F.col(f"_min_{c}") + 1e-12) for c in columns}
    return rows.withColumns(out).drop(*stats.columns)


def normalised_time(df: DataFrame, where: Column | None = None, t: str = "t") -> DataFrame:
    return range_scaled(df.withColumn("t_norm", F.col(t).cast("double")), ["t_norm"], where)


def fit_scaler(df: DataFrame, columns: Sequence[str], kind: str = "standard", where: Column | None = None) -> DataFrame:
    """One row for each column: (name, kind, centre, scale); a scale of zero counts as 1."""
    if kind not in ("standard", "minmax"):
        raise ValueError("kind is 'standard' or 'minmax'")
    seen = df.where(where) if where is not None else df
    centre, scale = (F.avg, F.stddev_pop) if kind == "standard" else (F.min, lambda c: F.max(c) - F.min(c))
    one = seen.agg(*[x for c in columns for x in (centre(c).cast("double").alias(f"c_{c}"), scale(c).cast("double").alias(f"s_{c}"))])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(kind).alias("kind"), F.col(f"c_{c}").alias("centre"), F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")).alias("scale")) for c in columns]))
    return one.select(each.alias("e")).select("e.*")


def _with_scaler(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = scaler.agg(*[x for c in columns for x in (F.max(F.when(F.col("name") == c, F.col("centre"))).alias(f"_c_{c}"), F.max(F.when(F.col("name") == c, F.col("scale"))).alias(f"_s_{c}"))])
    return df.join(wide)


def transform(df: DataFrame, scaler: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    if scaler is None:
        raise ValueError("fit the scaler first")
    rows = _with_scaler(df, scaler, columns)
    return rows.withColumns({c: (F.col(c) - F.col(f"_c_{c}")) / F.col(f"_s_{c}") for c in columns}).select(*df.columns)


def inverse_transform(df: DataFrame, scaler: DataFrame | None, columns: Sequence[str], of: dict[str, str] | None = None) -> DataFrame:
    """Back to raw values; ``of`` names the scaled column that a column (a prediction) is in."""
    if scaler is None:
        raise ValueError("fit the scaler first")
    source = {c: (of or {}).get(c, c) for c in columns}
    rows = _with_scaler(df, scaler, sorted(set(source.values())))
    return rows.withColumns({c: F.col(c) * F.col(f"_s_{s}") + F.col(f"_c_{s}") for c, s in source.items()}).select(*df.columns)


def standardised(df: DataFrame, column: str, where: Column) -> DataFrame:
    """``column`` standardised by mean and population deviation of the rows with ``where``, with the
    two numbers as columns _mean and _sd; a deviation below 1e-12 counts as 1."""
    stats = df.where(where).agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_sd"))
    stats = stats.withColumn("_sd", F.when(F.col("_sd") < 1e-12, 1.0).otherwise(F.col("_sd")) + 1e-12)
    return df.join(stats).withColumn(column, (F.col(column) - F.col("_mean")) / F.col("_sd"))


def variance_to_raw(column: Column) -> Column:
    """A variance of the standardised target, on the target's own scale."""
    return column * F.col("_sd") * F.col("_sd")


def to_raw(column: Column) -> Column:
    return column * F.col("_sd") + F.col("_mean")


def centred_by_site(df: DataFrame, column: str, where: Column, site: str = "site_id") -> DataFrame:
    """``column`` less its mean at the site over the rows with ``where``."""
    means = df.where(where).groupBy(site).agg(F.avg(column).alias("_site_mean"))
    return df.join(means, site).withColumn(column, F.col(column) - F.col("_site_mean")).drop("_site_mean")


# ---------------------------------------------------------------- joins and shapes


def align(truth: DataFrame, predictions: DataFrame, keys: Sequence[str] = ("site_id", "t")) -> DataFrame:
    """Every true value with its prediction, or null."""
    return truth.join(predictions, list(keys), "left")


def packed(panel: DataFrame, value: str = "z") -> DataFrame:
    """(t, ids, vals): the sites seen at a time, in order, and their values; duplicates averaged."""
    cells = panel.groupBy("t", "site_id").agg(F.avg(value).alias("_v"))
    rows = cells.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("site_id", "_v"))).alias("_c"))
    return rows.select("t", F.col("_c.site_id").alias("ids"), F.col("_c._v").alias("vals"))


def unpacked(rows: DataFrame, value: str = "z") -> DataFrame:
    return rows.select("t", F.explode(F.arrays_zip("ids", "vals")).alias("_c")).select("t", F.col("_c.ids").alias("site_id"), F.col("_c.vals").alias(value))


def full_frame(panel: DataFrame, times: DataFrame, sites: DataFrame) -> DataFrame:
    """Every (t, site), with null where nothing was seen. The frame itself is the result's size."""
    frame = times.select("t").distinct().crossJoin(sites.select("site_id").distinct())
    return frame.join(panel, ["t", "site_id"], "left")


def previous_step(df: DataFrame, keys: Sequence[str], t: str, value: str) -> DataFrame:
    """Pairs of neighbouring steps: ``value`` and ``before``, for each key."""
    return df.withColumn("before", F.lag(value).over(Window.partitionBy(*keys).orderBy(t))).where("before IS NOT NULL")


def rolling_median(df: DataFrame, keys: Sequence[str], order: str, value: str, width: int) -> DataFrame:
    """Centred, over the values that there are: ``width // 2`` rows before, the rest after."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2)
    return df.withColumn("median", F.percentile(value, F.lit(0.5)).over(frame))
