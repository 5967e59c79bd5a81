"""Incremental ingest: micro-batches put into a collection by the same upsert as in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.collection import Collection, keep_last


def stream_upsert(spark: SparkSession, landing: str, schema: StructType, target: Collection, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, order=None, files_per_batch: int | None = None, names: str | None = None) -> StreamingQuery:
    """Reads Parquet files as they land, prepares each micro-batch and upserts it; runs until what is there now is done.

    A batch is upserted whole by key, so one that is run again after a failure
    leaves the same rows.  Of equal keys in a batch the first in ``order`` counts.
    ``names`` is a pattern that file names must match.
    """
    source = spark.readStream.schema(schema)
    if names:
        source = source.option("pathGlobFilter", names)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)

    def put(batch: DataFrame, _: int) -> None:
        rows = prepare(batch)
        target.add(keep_last(rows, target.key, order) if order else rows.dropDuplicates([target.key]))

    return source.parquet(landing).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
