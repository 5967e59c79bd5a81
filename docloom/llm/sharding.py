"""Sharding: contiguous shards of equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import reliable

N_SHARDS = 64


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """(doc_id, n_bytes, start_byte, shard_id) of every row, shards contiguous in (doc_id, n_bytes).

    Sizes are summed per range partition; the prefix sums of these totals, one
    row per partition, are the offsets at which each partition's own running sum
    starts.  A document goes to the shard in which its first byte lies when all
    bytes are cut at ``n_shards`` equal targets, so a shard differs from the
    target by less than one document.  Only ids and sizes are shuffled.

    Defined cases: null doc_ids come first; a null or empty text has 0 bytes and
    goes to the shard of its position; rows equal in doc_id and size are
    interchangeable; if no document has a byte all are in shard 0; an empty
    table gives no rows; shards may be empty where one document spans several
    targets.  Other columns are ignored.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = reliable(sizes.repartitionByRange(parts, "doc_id", "n_bytes").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("n_bytes").alias("t"))
    # One row per partition: a window without keys is small here, and its result too.
    offsets = totals.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("offset"), F.sum("t").over(Window.partitionBy()).alias("total"))
    running = Window.partitionBy("part").orderBy("doc_id", "n_bytes").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("upto", F.sum("n_bytes").over(running)).join(offsets, "part")
    start = F.col("offset") + F.col("upto") - F.col("n_bytes")
    return placed.select("doc_id", "n_bytes", start.alias("start_byte"), F.col("total")).select(
        "doc_id", "n_bytes", "start_byte", F.least(F.lit(n_shards - 1), F.expr(f"(start_byte * {n_shards}) div greatest(total, 1)")).cast("bigint").alias("shard_id")
    )


SQL = f"""
WITH s AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes FROM documents),
r AS (SELECT *, CAST(sum(n_bytes) OVER (ORDER BY doc_id NULLS FIRST, n_bytes ROWS UNBOUNDED PRECEDING) - n_bytes AS BIGINT) AS start_byte, CAST(sum(n_bytes) OVER () AS BIGINT) AS total FROM s)
SELECT doc_id, n_bytes, start_byte, CAST(least({N_SHARDS - 1}, start_byte * {N_SHARDS} // greatest(total, 1)) AS BIGINT) AS shard_id FROM r
"""
