"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ConfigError


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; only where nothing is named and all runs on one machine, as in tests, in a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ConfigError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docloom-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows checkpointed in that folder, so that loops don't grow plans and lost executors don't matter."""
    scratch(df.sparkSession, "")
    return df.checkpoint(eager=True)


#: Rows of hits up to which they are sent to all executors.
FEW = 100_000


def few(df: DataFrame) -> DataFrame:
    """Narrow rows such as hits, cut and counted, and to be sent to the larger side of a join if they are few."""
    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= FEW else kept
