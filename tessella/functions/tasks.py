"""Linear algebra of bounded size in a Spark task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession


def in_task(spark: SparkSession, f: Callable, *args):
    """``f(*args)``, computed by one task and sent back. For matrices of a checked size: tasks run linear
    algebra on the cores that Spark gives them, so it neither takes the driver's cores nor waits in the
    driver's thread pool, where the inverse of a 123 x 123 matrix was seen to stall after Spark jobs."""
    shared = spark.sparkContext.broadcast(args)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(f(*shared.value))], pa.binary())], names=["out"])

    return pickle.loads(spark.range(0, 1, 1, 1).mapInArrow(run, "out binary").first()[0])
