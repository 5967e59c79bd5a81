"""Post-processing of hits: filters, deduplication, context, budgets, reranking, selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidInput
from ..functions.text import terms, token_estimate

Step = Callable[[DataFrame], DataFrame]


def pipeline(*steps: Step) -> Step:
    """Steps one after the other."""
    if not steps:
        raise InvalidInput("a pipeline needs a step")
    return lambda df: reduce(lambda d, s: s(d), steps, df)


def similarity_filter(hits: DataFrame, threshold: float = 0.7, score: str = "score") -> DataFrame:
    """Hits of at least the threshold; null scores go."""
    if not 0 <= threshold <= 1:
        raise InvalidInput("threshold must lie in [0, 1]")
    return hits.where(F.col(score) >= threshold)


def deduplicate(hits: DataFrame, key: Column, order: Sequence[Column], within: Sequence[str] = ("query_id",)) -> DataFrame:
    """The first in ``order`` of those with equal keys; null keys are equal to each other."""
    w = Window.partitionBy(*within, key).orderBy(*order)
    return hits.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def context_window(hits: DataFrame, units: DataFrame, window: int = 1, unique: bool = True, chain: str = "doc_id", seq: str = "seq") -> DataFrame:
    """Each hit with up to ``window`` neighbours before and after it: (query_id, pos, shift, chain, seq).

    ``hits`` has (query_id, pos, chain, seq), ``units`` chain and seq without
    gaps.  Each hit asks for its 2 * window + 1 places, so the join is an
    equi-join.  With ``unique`` a unit stays where it came first in (pos, shift).
    """
    asked = hits.withColumn("shift", F.explode(F.sequence(F.lit(-window), F.lit(window)))).withColumn(seq, F.col(seq) + F.col("shift"))
    found = asked.join(units.select(chain, seq).distinct(), [chain, seq]).select("query_id", "pos", "shift", chain, seq)
    return deduplicate(found, F.struct(chain, seq), [F.col("pos"), F.col("shift")]) if unique else found


def table_context(units: DataFrame, is_table: Column, mode: str = "sibling", chain: str = "doc_id", seq: str = "seq", text: str = "content", sep: str = "\n\n") -> DataFrame:
    """Table units take in the text before and/or after them; neighbours taken in are removed, tables among them too.

    mode: "prev", "next" or "sibling" (both).
    """
    if mode not in ("prev", "next", "sibling"):
        raise InvalidInput(mode)
    w = Window.partitionBy(chain).orderBy(seq)
    u = units.withColumn("_t", F.coalesce(is_table, F.lit(False)))
    before = F.lag(text).over(w) if mode != "next" else F.lit(None).cast("string")
    after = F.lead(text).over(w) if mode != "prev" else F.lit(None).cast("string")
    taken = F.lit(False)
    if mode != "prev":
        taken = taken | F.coalesce(F.lag("_t").over(w), F.lit(False))
    if mode != "next":
        taken = taken | F.coalesce(F.lead("_t").over(w), F.lit(False))
    u = u.withColumns({"_text": F.when(F.col("_t"), F.concat_ws(sep, before, F.col(text), after)).otherwise(F.col(text)), "_taken": taken})
    return u.where(~F.col("_taken")).withColumn(text, F.col("_text")).drop("_t", "_text", "_taken")


def token_budget(hits: DataFrame, most: int = 4000, strategy: str = "smart", text: str = "content", within: Sequence[str] = ("query_id",), pos: str = "pos", score: str = "score", chars_per_token: float = 4.0) -> DataFrame:
    """Hits in order while their running number of tokens is within ``most``: by score ("smart") or as they come ("truncate")."""
    if strategy not in ("smart", "truncate"):
        raise InvalidInput(strategy)
    order = [F.col(score).desc(), F.col(pos)] if strategy == "smart" else [F.col(pos)]
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cost = F.coalesce(token_estimate(F.col(text), chars_per_token), F.lit(0))
    return hits.withColumn("used_tokens", F.sum(cost).over(w)).where(F.col("used_tokens") <= most)


def rerank_text(head: Sequence[Column], content: Column, most: int = 2000) -> Column:
    """"[a | b]" of the parts that aren't null, a line end and the content, cut at ``most`` characters: what a reranker sees."""
    prefix = F.concat_ws(" | ", *(F.when(F.trim(c) != "", c) for c in head))
    return F.substring(F.concat(F.when(prefix != "", F.concat(F.lit("["), prefix, F.lit("]\n"))).otherwise(""), F.coalesce(content, F.lit(""))), 1, most)


def lexical_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct terms that the text has; 0 for an empty query."""
    q = F.array_distinct(terms(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, terms(text))) / F.size(q)).otherwise(0.0)


def rerank(hits: DataFrame, score: Column, k: int, unit: str = "unit_id") -> DataFrame:
    """Scores anew and keeps the k best of each query."""
    scored = hits.withColumn("score", F.round(score, 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), unit)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def select_sentences(query: Column, text: Column) -> Column:
    """Sentences that share a term with the query, joined by blank lines; null if none does."""
    q = F.array_distinct(terms(query))
    kept = F.filter(F.split(text, r"(?<=[.!?。])\s+"), lambda s: F.arrays_overlap(terms(s), q))
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n\n"))


def select_excerpts(hits: DataFrame, is_table: Column, query: str = "query", text: str = "content") -> DataFrame:
    """Tables stay as they are; other units are cut to what concerns the query, and go if nothing does."""
    out = hits.withColumn(text, F.when(is_table, F.col(text)).otherwise(select_sentences(F.col(query), F.col(text))))
    return out.where(F.col(text).isNotNull())
