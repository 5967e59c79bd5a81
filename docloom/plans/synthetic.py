"""Markdown, chains and layouts made from the driver's tables, for operators whose input these don't have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as a chain of units: conversation and turn, their text."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def chats_markdown(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): a conversation as Markdown, a heading and a text for every turn: "# system", "## user", "### assistant"."""
    t = turns(spark, d)
    marks = F.when(F.col("role") == "system", "#").when(F.col("role") == "user", "##").otherwise("###")
    part = F.concat(marks, F.lit(" "), F.col("role"), F.lit("\n"), F.col("content"))
    each = F.array_sort(F.collect_list(F.struct("seq", part.alias("p"))))
    return t.groupBy("doc_id").agg(F.array_join(F.transform(each, lambda x: x["p"]), "\n\n").alias("text"))


CHATS_SQL = """chats AS (SELECT conv_id AS doc_id, string_agg(CASE role WHEN 'system' THEN '#' WHEN 'user' THEN '##' ELSE '###' END || ' ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""
