"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. In local mode one is made
    where none is named; on a cluster no machine's own folder would do, so that is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-tessella-")
    return _OWN[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a lost executor
    costs no more than the tasks it ran, and a result that is used twice is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Remove written tables that no later step reads, so that the shared folder holds what is in use."""
    for df in tables:
        files = df.inputFiles()
        if files:
            jvm = df.sparkSession.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: A key with more than this share of all rows is dealt with by itself; there are fewer such keys.
HEAVY = 1000


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, whose rows are unique by ``on`` and have in ``n`` how many rows
    of ``rows`` have that key (for ``left_semi``, ``inner`` and ``left``; keys are never null).

    Keys that hold more than 1 / HEAVY of all rows are broadcast: fewer than HEAVY rows, whatever the
    data. The others are shuffled, and none of them can fill a task. Both are written tables."""
    total = rows.count()
    heavy = F.broadcast(table.where(F.col("n") * HEAVY > total))
    light = table.where(F.col("n") * HEAVY <= total)
    first = rows.join(heavy, on, "inner" if how == "left" else how)
    return first.unionByName(rows.join(heavy.select(*on), on, "left_anti").join(light, on, how))


def join_listed(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """As ``join_counted``, for one key column: the heavy keys, fewer than HEAVY, are listed in a filter, so that the
    other rows pass through one join only."""
    total = rows.count()
    heavy = [r[0] for r in table.where(F.col("n") * HEAVY > total).select(on).collect()]
    if not heavy:
        return rows.join(table, on)
    own = F.col(on).isin(heavy)
    return rows.where(own).join(F.broadcast(table.where(own)), on).unionByName(rows.where(~own).join(table.where(~own), on))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """All renamings at once; a new name may equal an old one."""
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def first_by_hash(df: DataFrame, rows: int, most: int, *columns: str) -> DataFrame:
    """The ``most`` rows that come first in the order of a hash of ``columns``; ``rows``: how many
    there are. Where they are many more, only a share by the hash that holds about four times
    ``most`` is ordered, so that no task gathers ``most`` rows from each of all others."""
    h = F.xxhash64(*columns)
    if rows > 4 * most:
        df = df.where(h < -(1 << 63) + int((1 << 64) * (4 * most / rows)))
    return df.orderBy(h, *columns).limit(most)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose ``column`` holds about ``limit`` bytes each, so that the arrays built
    from one part stay small however large Spark's batches are. A longer row is a part of its own."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    ends, start, total = np.cumsum(sizes), 0, 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(ends, total + limit, side="right")))
        yield batch.slice(start, end - start)
        total, start = int(ends[end - 1]), end
