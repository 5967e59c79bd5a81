"""Sessions with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .workers import importable

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "docloom", **settings: str) -> SparkSession:
    """A session with the defaults, overridden by ``settings`` (``__`` stands for a dot in names)."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    importable(spark)
    return spark
