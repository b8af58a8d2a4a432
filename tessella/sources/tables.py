"""Readers and writers of panels, cubes, annotations, results and predictions."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.arrays import parts_of, registered

OBSERVATIONS = "x double, y double, t long, z double"
RESULTS = "experiment string, seed int, model string, split string, metric string, value double"
EIGENVALUES = "component int, eigenvalue double, cumulative_explained_variance double"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """The columns x, y, t and z of a CSV with header, whatever else and in what order it has."""
    names = spark.read.option("header", True).csv(path).columns
    missing = {"x", "y", "t", "z"} - set(names)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    kinds = {"x": "double", "y": "double", "t": "double", "z": "double"}
    own = spark.read.option("header", True).schema(", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in names)).csv(path)
    return own.select("x", "y", F.col("t").cast("long").alias("t"), "z")


def read_cube(spark: SparkSession, path: str, variable: int, lat: int = 0, lon: int = 1, keep: int | None = None, start: int = 0, sites: int = 1024) -> DataFrame:
    """(site_id, x, y, t, z) of a (site, variable, time) array file, or a folder of such files. A task reads the byte
    ranges of up to ``sites`` sites; ``keep``: the last so many times, from ``start`` on, and only these are
    read; non-finite values are left out."""
    shape = cube_shape(path)
    if not all(0 <= v < shape[1] for v in (variable, lat, lon)):
        raise ValueError(f"variables are numbered 0 to {shape[1] - 1}")
    if keep is not None and not 0 < keep <= shape[2]:
        raise ValueError(f"keep is 1 to {shape[2]}")
    first = max(start, shape[2] - keep if keep else 0)
    cube = registered(spark).read.format("tessella_cube").options(lat=lat, lon=lon, sites=sites).load(path)
    return cube.where((F.col("variable") == variable) & (F.col("t") >= first)).select("site_id", "x", "y", (F.col("t") - first).alias("t"), "z")


def cube_shape(path: str) -> tuple[int, int, int]:
    parts = parts_of(path)
    if any(len(p.shape) != 3 for p in parts):
        raise ValueError("a cube has three axes: site, variable, time")
    return (parts[-1].first + parts[-1].shape[0], *parts[-1].shape[1:])


def write_cube(cells: DataFrame, path: str, shape: tuple[int, int, int], sites: int = 64) -> None:
    """(i, variable, t, value) as a folder of (site, variable, time) array files of doubles, up to ``sites`` sites each;
    cells that are not given are NaN, and every site from 0 on needs a cell."""
    rows = cells.select(F.floor(F.col("i") / sites).cast("long").alias("part"), F.col("i").cast("long").alias("i"), F.col("variable").cast("int").alias("variable"), F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("value"))
    rows = rows.repartition("part").sortWithinPartitions("part")
    registered(cells.sparkSession)
    rows.write.format("tessella_cube").options(shape=",".join(map(str, shape)), sites=sites).mode("append").save(path)


def save_cube_part(spark: SparkSession, path: str, out: str, variable: int, keep: int, **options) -> None:
    read_cube(spark, path, variable, keep=keep, **options).write.mode("overwrite").parquet(out)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, bbox) of either header dialect; other columns are dropped."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    for old, new in (("image_name", "image_id"), ("BoxesString", "bbox")):
        if new not in df.columns and old in df.columns:
            df = df.withColumnRenamed(old, new)
    if "image_id" not in df.columns:
        raise ValueError("there is no image column")
    return df.select(F.regexp_replace("image_id", r"\.(jpg|png)$", "").alias("image_id"), F.col("bbox") if "bbox" in df.columns else F.lit(None).cast("string").alias("bbox"))


def read_results(spark: SparkSession, root: str, names: Sequence[str], prefixes: Sequence[str] = ("",)) -> tuple[DataFrame | None, list[str]]:
    """Result tables of many experiments, each at the first prefix that has it, and the missing."""
    found, missing = {}, []
    for name in names:
        path = next((p for prefix in prefixes if _exists(spark, p := f"{root}/{prefix}{name}.csv")), None)
        if path:
            found[name] = path
        else:
            missing.append(name)
    if not found:
        return None, missing
    df = spark.read.option("header", True).schema(RESULTS).csv(list(found.values()))
    return df.withColumn("experiment", F.regexp_extract(F.input_file_name(), r"([^/]+?)\.csv", 1)), missing


def read_trials(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Trial tables of several seeds in one; columns that a file lacks are null."""
    out = None
    for path in paths:
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_archives(spark: SparkSession, folder: str, pattern: str = "seed_*.npz") -> DataFrame:
    """Predictions (seed, model, site, t, y_true, y_pred) of small archives of (time, site) matrices:
    y_true and one matrix for each model; a file is a row. Vectors t and site_id name times and sites;
    without them both are numbered. NaN comes out as null."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                data = np.load(io.BytesIO(content), allow_pickle=False)
                truth = data["y_true"]
                t, s = np.indices(truth.shape)
                if "t" in data and "site_id" in data:
                    t, s = data["t"][t], data["site_id"][s]
                seed = int(data["seed"]) if "seed" in data else int("".join(c for c in path.rsplit("/", 1)[-1] if c.isdigit()) or 0)
                for name in data.files:
                    if name not in ("y_true", "seed") and data[name].shape == truth.shape:
                        yield pd.DataFrame({"seed": seed, "model": name, "site_id": s.ravel(), "t": t.ravel(), "y_true": truth.ravel().astype(float), "y_pred": data[name].ravel().astype(float)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    return files.mapInPandas(run, "seed int, model string, site_id long, t long, y_true double, y_pred double")


def write_archives(df: DataFrame, folder: str, times: int = 256, sites: int = 1024) -> None:
    """Predictions as archives. A seed's matrix is cut into parts of so many times and about so many sites, so no task
    holds a whole one; cells that are not given are NaN."""
    blocks = max(1, -(-df.select("site_id").distinct().count() // sites))
    rows = df.select(F.col("seed").cast("long").alias("seed"), F.floor(F.col("t") / times).cast("long").alias("span"), F.pmod(F.xxhash64("site_id"), F.lit(blocks)).alias("block"), "model", "site_id", "t", "y_true", "y_pred")
    rows = rows.repartition("seed", "span", "block").sortWithinPartitions("seed", "span", "block")
    registered(df.sparkSession)
    rows.write.format("tessella_archives").mode("append").save(folder)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("seed").parquet(path)


def write_results(df: DataFrame, path: str) -> bool:
    """One CSV folder with header; nothing is written for an empty table."""
    if not df.head(1):
        return False
    df.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_timings(frames: Sequence[DataFrame], path: str) -> None:
    """Timings with the union of all their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_eigenvalues(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(EIGENVALUES).csv(path)


def cached(spark: SparkSession, folder: str, parameters: dict, compute: Callable[[], DataFrame]) -> DataFrame:
    """What is stored under these parameters, or ``compute``'s result, which is then stored."""
    path = f"{folder}/" + "-".join(f"{k}={parameters[k]}" for k in sorted(parameters))
    if not _exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
