"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, the same in Java, RE2 and Python.
SPACE = r" \t\n\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: what the session names in ``spark.checkpoint.dir``.

    Only where nothing is named and all runs on one machine, as in tests, a
    temporary one is made; a cluster without a shared folder is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docloom-checkpoint-"))
    return sc.getCheckpointDir()


def reliable(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """The same for steps of a loop: estimates and constraints of the plan, which a checkpoint keeps and which multiply with every round, are forgotten too."""
    done, spark = reliable(df), df.sparkSession
    rows = done._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than blank, tab and line ends; null counts 0."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SPACE}]+", "x"), f"[{SPACE}]+", ""))


def hidden(df: DataFrame, *names: str) -> list[str]:
    """Column names derived from ``names`` that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        out.append(name)
        taken.add(name.lower())
    return out


#: Rows of a few numbers each up to which a side is sent to all executors.
BROADCAST_ROWS = 1_000_000


def if_small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a narrow, already materialised side for broadcasting if it has at most ``most`` rows; else the join is left to shuffle."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


#: Bytes up to which a side is sent to all executors.
BROADCAST_BYTES = 24 << 20


def if_light(df: DataFrame, row_bytes: Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks an already materialised side for broadcasting if its rows, each of ``row_bytes``, are at most ``most`` bytes in all; else the join is left to shuffle."""
    size = df.agg(F.sum(row_bytes.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


@contextlib.contextmanager
def small_steps(spark: SparkSession, rows: int, each: int = 100_000) -> Iterator[None]:
    """For loops of eager steps over a table of ``rows``: inside, shuffles have a partition for so many narrow rows ``each``."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(1, -(-rows // each))))
    try:
        yield
    finally:
        spark.conf.set(name, before)
