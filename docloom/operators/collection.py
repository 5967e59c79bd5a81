"""Collections of units: add, upsert, patch, remove, fetch, count and search over versioned Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidInput, StepFailed
from . import search
from .filters import compile_filter, where


def keep_last(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def upsert(existing: DataFrame, new: DataFrame, key: str = "unit_id") -> DataFrame:
    """Rows of ``new`` take the place of those with equal keys; the rest stays.  Of rows of ``new`` with one key, one stays."""
    new = new.dropDuplicates([key])
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def update(existing: DataFrame, new: DataFrame, key: str = "unit_id") -> DataFrame:
    """Like upsert, but keys that don't exist are left out."""
    return upsert(existing, new.join(existing.select(key), key, "left_semi"), key)


def delete(existing: DataFrame, ids: DataFrame, key: str = "unit_id") -> DataFrame:
    return existing.join(ids.select(key), key, "left_anti")


def remove(existing: DataFrame, condition: Mapping | str | Column | None) -> DataFrame:
    """Without the rows that the filter matches; an empty filter is refused."""
    if condition is None or (isinstance(condition, Mapping) and not condition):
        raise InvalidInput("remove needs a filter")
    return existing.where(~compile_filter(existing, condition))


def get(existing: DataFrame, ids: Sequence, key: str = "unit_id") -> DataFrame:
    """Rows by id in the order asked for; unknown ids are skipped."""
    asked = existing.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], f"{key} {existing.schema[key].dataType.simpleString()}, _at int")
    return existing.join(F.broadcast(asked), key).orderBy("_at").drop("_at")


def patch(existing: DataFrame, condition: Mapping | str | Column, changes: Mapping[str, object]) -> DataFrame:
    """Sets fields, dotted paths into structs included, on the rows that match; all else stays."""
    hit = compile_filter(existing, condition)
    for path, value in changes.items():
        head, _, rest = path.partition(".")
        column = value if isinstance(value, Column) else F.lit(value)
        new = F.col(head).withField(rest, column) if rest else column
        existing = existing.withColumn(head, F.when(hit, new).otherwise(F.col(head)))
    return existing


def fetch(existing: DataFrame, condition=None, limit: int | None = None, order: Sequence[str] = ("unit_id",)) -> DataFrame:
    """Rows that match, without ranking; with a limit, the first in ``order``."""
    rows = where(existing, condition)
    return rows if limit is None else rows.orderBy(*order).limit(limit)


class Collection:
    """A named set of units.  In memory it is a DataFrame; on disk, version folders and a table of which one counts.

    A new version is written whole before the pointer names it, so a reader sees
    the old or the new one and a failed write changes nothing.  Of two writers
    that started from one version the second fails.  The last ``KEEP`` versions
    stay, for readers that are still at work; older ones are removed.
    """

    KEEP = 3

    def __init__(self, spark: SparkSession, rows: DataFrame | None, path: str | None = None, key: str = "unit_id"):
        self.spark, self.path, self.key, self._rows = spark, path, key, rows

    @classmethod
    def in_memory(cls, rows: DataFrame, key: str = "unit_id") -> Collection:
        return cls(rows.sparkSession, rows, None, key)

    @classmethod
    def local(cls, spark: SparkSession, path: str, key: str = "unit_id") -> Collection:
        """A collection in a folder of any file system that Spark reads."""
        return cls(spark, None, path, key)

    @classmethod
    def server(cls, *_: object, **__: object) -> Collection:
        raise NotImplementedError("collections are tables; there is no server to call")

    cloud = server

    def _pointer(self) -> str:
        return f"{self.path}/current"

    def _version(self) -> str | None:
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self._pointer()).getFileSystem(self.spark._jsc.hadoopConfiguration())
        paths = self.spark._jvm.org.apache.hadoop.fs.Path
        if not fs.exists(paths(self._pointer())):
            return None
        return max(((f.getPath().getName()) for f in fs.listStatus(paths(self._pointer()))), default=None)

    @property
    def rows(self) -> DataFrame:
        if self.path is None:
            if self._rows is None:
                raise InvalidInput("the collection was deleted")
            return self._rows
        version = self._version()
        if version is None:
            raise InvalidInput(f"nothing was added to {self.path}")
        return self.spark.read.parquet(f"{self.path}/data/{version}")

    def _put(self, rows: DataFrame) -> None:
        if self.path is None:
            self._rows = rows
            return
        number = int((self._version() or "0").split("-")[0]) + 1
        name = f"{number:012d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/data/{name}")
        paths = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = paths(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(paths(f"{self.path}/claims"))
        if not fs.createNewFile(paths(f"{self.path}/claims/{number:012d}")):
            fs.delete(paths(f"{self.path}/data/{name}"), True)
            raise StepFailed(f"version {number} of {self.path} was written by another")
        fs.mkdirs(paths(f"{self._pointer()}/{name}"))  # one step: the version counts from here on
        for old in sorted(f.getPath().getName() for f in fs.listStatus(paths(self._pointer())))[: -self.KEEP]:
            fs.delete(paths(f"{self._pointer()}/{old}"), True)
            fs.delete(paths(f"{self.path}/data/{old}"), True)

    def _empty(self) -> bool:
        return self._rows is None if self.path is None else self._version() is None

    def add(self, units: DataFrame) -> None:
        """Inserts or replaces by key."""
        self._put(units.dropDuplicates([self.key]) if self._empty() else upsert(self.rows, units, self.key))

    upsert = add

    def update(self, units: DataFrame) -> None:
        self._put(update(self.rows, units, self.key))

    def delete(self, ids: DataFrame) -> None:
        self._put(delete(self.rows, ids, self.key))

    def remove(self, condition) -> None:
        self._put(remove(self.rows, condition))

    def patch(self, condition, changes: Mapping[str, object]) -> None:
        if changes:
            self._put(patch(self.rows, condition, changes))

    def clear(self) -> None:
        self._put(self.rows.limit(0))

    def get(self, ids: Sequence) -> DataFrame:
        return get(self.rows, ids, self.key)

    def fetch(self, condition=None, limit: int | None = None) -> DataFrame:
        return fetch(self.rows, condition, limit, (self.key,))

    def count(self, condition=None) -> int:
        return where(self.rows, condition).count()

    def exists(self, key) -> bool:
        return not self.rows.where(F.col(self.key) == F.lit(key)).isEmpty()

    def dimension(self, column: str = "embedding") -> int:
        """Length of the vectors; several lengths raise."""
        found = self.rows.where(F.col(column).isNotNull()).agg(F.min(F.size(column)).alias("a"), F.max(F.size(column)).alias("b")).first()
        if found["a"] != found["b"]:
            raise InvalidInput("vectors differ in length")
        return found["a"] or 0

    def search(self, queries: DataFrame, k: int = 10, condition=None, metric: str = "cosine", query_id: str = "query_id") -> DataFrame:
        """(query_id, id, score, rank), the best k of the rows that the filter matches."""
        return search.knn(queries, where(self.rows, condition), k, metric, query_id, self.key)
