"""Arrow functions on executors, whose Python workers must find this package."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Arrays of some size, Arrow's as well, go back to the system when they are done, so that workers that are used again stay small.
MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20)}


def importable(spark: SparkSession) -> None:
    """Puts this package's folder on the path of workers started from now on; it is the same on all nodes, or installed there."""
    env = spark.sparkContext.environment
    for name, value in MEMORY.items():
        env.setdefault(name, value)
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


#: Bytes at which a batch for a worker is closed, if the session names no other number.  A batch is there several times over: as buffers that the JVM lets grow, on the way, and as arrays of the worker.
BATCH_BYTES = 2 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def giving_back(function: Callable) -> Callable:
    """``function`` over a task's batches; when it has ended, the worker returns its free memory to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return run


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with workers that can import this package, in batches of bounded size."""
    spark = df.sparkSession
    importable(spark)
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(giving_back(function), schema)
