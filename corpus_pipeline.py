"""From documents to packed training windows, in five stages."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import jaccard, knn, mixing, packing, secrets
from docloom.llm.common import shared_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; its labels are those of ``sf_dir``, matched with the stage's own input.

    Null, empty and wordless texts stay, repeated rows share their fate, long
    texts are read whole, without labels all stay, an empty table gives no rows.
    """
    return knn.filter_quality(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near documents one stays, the one with the smallest doc_id.

    Texts without words are near to none and stay, of rows equal in doc_id and
    text one stays, null doc_ids come last, an empty table gives no rows.
    """
    return jaccard.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask, and n_chars is made to match; every row stays, null and empty texts as they are."""
    return secrets.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn to their target weights; a document drawn several times is there several times.

    A null source is one of its own, rows equal in doc_id and text are drawn
    together, texts without words fit any budget, an empty table gives no rows.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are cut and packed into windows; one row per window.

    Texts without words are in none, long texts give several pieces, repeated
    rows are packed each, an empty table gives no rows.
    """
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("near duplicates", keep_one_of_each),
    ("secret scan", redact),
    ("mix sources", mix),
    ("pack", pack),
]

#: The classifier, the join's n-grams and the compressor can't be put in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of all stages applied to documents; each stage's rows are written to the shared folder and read again, and go when the next stage's are there.

    Null texts, empty tables, repeated rows and the like are treated as the
    stages' and their operators' docstrings say.
    """
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
