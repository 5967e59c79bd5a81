"""Fusion of several retrievers' hit lists: (query_id, retriever_idx, pos, unit_id, score)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidInput

RRF_K = 60


def _score() -> Column:
    return F.coalesce(F.col("score"), F.lit(0.0))


def _ranked(fused: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
    return fused.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reciprocal_rank(hits: DataFrame, k: int = 10, rrf_k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (rrf_k + rank), ranks from 0 by score within each list.  Scores are small: don't filter them by a similarity."""
    order = Window.partitionBy("query_id", "retriever_idx").orderBy(_score().desc(), "pos")
    r = hits.withColumn("r", F.row_number().over(order) - 1)
    return _ranked(r.groupBy("query_id", "unit_id").agg(F.sum(1.0 / (F.lit(rrf_k) + F.col("r"))).alias("score")), k)


def relative_score(hits: DataFrame, weights: Sequence[float], k: int = 10) -> DataFrame:
    """Sum of weight * min-max normalised score; a list of equal scores counts 1 each if they are positive, else 0.  Weights are normalised."""
    total = float(sum(weights))
    if total <= 0:
        raise InvalidInput("weights must have a positive sum")
    lists = Window.partitionBy("query_id", "retriever_idx")
    lo, hi = F.min(_score()).over(lists), F.max(_score()).over(lists)
    normal = F.when(hi > lo, (_score() - lo) / F.greatest(hi - lo, F.lit(1e-300))).when(hi > 0, 1.0).otherwise(0.0)
    weight = F.element_at(F.array(*(F.lit(w / total) for w in weights)), F.col("retriever_idx") + 1)
    each = hits.withColumn("part", normal * weight)
    return _ranked(each.groupBy("query_id", "unit_id").agg(F.sum("part").alias("score")), k)


def simple(hits: DataFrame, k: int = 10) -> DataFrame:
    """The largest score of each unit."""
    return _ranked(hits.groupBy("query_id", "unit_id").agg(F.max(_score()).alias("score")), k)


def fuse(lists: Sequence[DataFrame], mode: str = "simple", k: int = 10, weights: Sequence[float] | None = None, normalize: bool = False) -> DataFrame:
    """Unites (query_id, unit_id, score, rank) lists, in the order given, and fuses them; ``normalize`` maps a query's scores to [0, 1]."""
    if not lists or (weights is not None and len(weights) != len(lists)):
        raise InvalidInput("one weight a list is needed, and a list")
    each = [d.select("query_id", "unit_id", "score", F.col("rank").alias("pos")).withColumn("retriever_idx", F.lit(i)) for i, d in enumerate(lists)]
    hits = each[0]
    for d in each[1:]:
        hits = hits.unionByName(d)
    out = {"reciprocal_rank": lambda: reciprocal_rank(hits, k), "relative_score": lambda: relative_score(hits, weights or [1.0] * len(lists), k), "simple": lambda: simple(hits, k)}[mode]()
    if normalize:
        q = Window.partitionBy("query_id")
        lo, hi = F.min("score").over(q), F.max("score").over(q)
        out = out.withColumn("score", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(1.0))
    return out


def rewrite(queries: DataFrame, how: Callable[[Column], Column], column: str = "query") -> DataFrame:
    """Queries rewritten by a column function before they go to any retriever."""
    return queries.withColumn(column, how(F.col(column)))


def without_lod(units: DataFrame, mode: Column) -> DataFrame:
    """Without units that stand for a whole document at several levels of detail; before ranking, so that no page falls short."""
    return units.where(~F.coalesce(mode == "lod", F.lit(False)))
