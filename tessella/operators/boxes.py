"""Annotation boxes: parsing, merging, and labels on a grid of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"-?\d+(?:\.\d+)?"


def image_key(column: Column) -> Column:
    return F.regexp_replace(column, r"\.(jpg|png)$", "")


def merged_boxes(df: DataFrame, image: str = "image_id", bbox: str = "bbox") -> DataFrame:
    """One string for each image, in the strings' order; nulls are skipped."""
    return df.groupBy(image).agg(F.array_join(F.array_sort(F.collect_list(bbox)), ";").alias(bbox))


def parsed(bbox: Column) -> Column:
    """array<struct<xmin, ymin, xmax, ymax>>; parts without exactly four numbers are skipped.

    ``a b c d`` holds corners, ``[x, y, w, h]`` a corner and a size."""
    parts = F.when(bbox.isNull() | F.trim(bbox).isin("", "[]", "no_box"), F.array().cast("array<string>")).otherwise(F.split(bbox, ";"))

    def numbers(part: Column) -> Column:
        text = F.trim(part)
        n = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))
        return F.struct(F.startswith(text, F.lit("[")).alias("sized"), n.alias("n"))

    def box(found: Column) -> Column:
        corner = lambda i: F.get(found["n"], F.lit(i))
        end = lambda i: corner(i) + F.when(found["sized"], corner(i - 2)).otherwise(0.0)
        return F.struct(corner(0).alias("xmin"), corner(1).alias("ymin"), end(2).alias("xmax"), end(3).alias("ymax"))

    # The numbers of a part are extracted once, by the inner transform.
    whole = lambda part: F.regexp_like(F.trim(part), F.lit(rf"^\[?\s*{NUMBER}(\s*[,\s]\s*{NUMBER}){{3}}\s*\]?$"))
    return F.transform(F.transform(F.filter(parts, whole), numbers), box)


def covered_cells(df: DataFrame, image: str, boxes: str, grid: int = 16, size: int = 64) -> DataFrame:
    """(image, r, c): the distinct cells that some box of the image touches. A box outside the
    image covers none."""
    rows = df.select(image, F.explode(boxes).alias("b"))
    low = lambda v: F.greatest(F.lit(0), F.floor(v / size)).cast("int")
    high = lambda v: F.least(F.lit(grid), F.ceil(v / size)).cast("int") - 1
    rows = rows.select(image, low(F.col("b.xmin")).alias("c0"), high(F.col("b.xmax")).alias("c1"), low(F.col("b.ymin")).alias("r0"), high(F.col("b.ymax")).alias("r1"))
    rows = rows.where("c0 <= c1 AND r0 <= r1").distinct()
    rows = rows.withColumn("r", F.explode(F.sequence("r0", "r1"))).withColumn("c", F.explode(F.sequence("c0", "c1")))
    return rows.select(image, "r", "c").distinct()


def label_map(df: DataFrame, image: str, boxes: str, grid: int = 16, size: int = 64) -> DataFrame:
    """(image, r, c, label): 0 or 1 for each cell of each image, images without boxes included."""
    frame = df.select(image).distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    hit = covered_cells(df, image, boxes, grid, size).withColumn("label", F.lit(1.0))
    return frame.join(hit, [image, "r", "c"], "left").withColumn("label", F.coalesce("label", F.lit(0.0)))


def packed_labels(labels: DataFrame, image: str) -> DataFrame:
    """(image, labels): row by row; the array is of the grid's size."""
    cells = labels.groupBy(image).agg(F.sort_array(F.collect_list(F.struct("r", "c", "label"))).alias("_c"))
    return cells.select(image, F.col("_c.label").alias("labels"))


def grid_coordinates(spark, grid: int = 16) -> DataFrame:
    """(r, c, y, x), scaled to [0, 1]."""
    span = float(max(1, grid - 1))
    rows = spark.range(grid * grid).select(F.floor(F.col("id") / grid).cast("int").alias("r"), (F.col("id") % grid).cast("int").alias("c"))
    return rows.select("r", "c", (F.col("r") / span).alias("y"), (F.col("c") / span).alias("x"))


def block_means(cells: DataFrame, keys: list[str], value: str, block: int = 4) -> DataFrame:
    """A map (r, c, value) averaged over blocks."""
    at = lambda c: F.floor(F.col(c) / block).cast("int").alias(c)
    return cells.groupBy(*keys, at("r"), at("c")).agg(F.avg(value).alias(value))
