"""Retrievers: objects that answer a table of queries (query_id, query) with hits (query_id, unit_id, score, rank)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..folders import few
from ..providers import embed, reranker
from . import fulltext, fusion, post
from .collection import Collection

HITS = ("query_id", "unit_id", "score", "rank")


class VectorRetriever:
    """Nearest units of a collection with embeddings; queries are embedded by the same provider."""

    def __init__(self, collection: Collection, uri: str = "offline/words", metric: str = "cosine"):
        self.collection, self.uri, self.metric = collection, uri, metric

    def retrieve(self, queries: DataFrame, k: int = 10, condition=None) -> DataFrame:
        q = embed(queries.select("query_id", F.col("query").alias("content")), self.uri)
        hits = self.collection.search(q, k, condition, self.metric)
        return hits.select("query_id", F.col(self.collection.key).alias("unit_id"), "score", "rank")


class FullTextRetriever:
    """Best units of an index, without those that stand for a document at several levels of detail; scores in [0, 1)."""

    def __init__(self, index: fulltext.FullTextIndex, mode: str | None = None, fuzzy: bool = False):
        self.index, self.mode, self.fuzzy = index, mode, fuzzy

    def retrieve(self, queries: DataFrame, k: int = 10, condition=None, sort: str | None = None) -> DataFrame:
        index = self.index
        if self.mode:
            rows = fusion.without_lod(index.rows, F.col(self.mode))
            index = fulltext.FullTextIndex(rows, index.key, index.text, index.sortable)
        hits = index.search(queries, k, condition, sort, self.fuzzy)
        return hits.select("query_id", F.col(index.key).alias("unit_id"), F.round(fulltext.ranking_score(F.col("score")), 6).alias("score"), "rank")


class FusionRetriever:
    """Asks each retriever for 2k hits and fuses their lists; a weight belongs to its retriever, in the order given."""

    def __init__(self, retrievers: Sequence, mode: str = "simple", weights: Sequence[float] | None = None, normalize: bool = False):
        if not retrievers or (weights is not None and len(weights) != len(retrievers)):
            raise InvalidInput("retrievers are needed, and one weight each")
        self.retrievers, self.mode, self.weights, self.normalize = list(retrievers), mode, weights, normalize

    def retrieve(self, queries: DataFrame, k: int = 10, condition=None) -> DataFrame:
        lists = [r.retrieve(queries, 2 * k, condition) for r in self.retrievers]
        return fusion.fuse(lists, self.mode, k, self.weights, self.normalize).select(*HITS)


class RewriteRetriever:
    """Rewrites queries by a column function first."""

    def __init__(self, retriever, how: Callable[[Column], Column]):
        self.retriever, self.how = retriever, how

    def retrieve(self, queries: DataFrame, k: int = 10, condition=None) -> DataFrame:
        return self.retriever.retrieve(fusion.rewrite(queries, self.how), k, condition)


class Reranker:
    """Scores hits anew; ``score`` takes the query and the text shown, offline the share of the query's terms that the text has."""

    def __init__(self, score: Callable[[Column, Column], Column] | str = post.lexical_score, head: Sequence[str] = (), most: int = 2000):
        self.score, self.head, self.most = reranker(score) if isinstance(score, str) else score, head, most

    def rerank(self, hits: DataFrame, queries: DataFrame, units: DataFrame, k: int, key: str = "unit_id", text: str = "content") -> DataFrame:
        shown = post.rerank_text([F.col(c).cast("string") for c in self.head], F.col(text), self.most)
        u = units.select(F.col(key).alias("unit_id"), shown.alias("_shown"))
        joined = few(hits.select("query_id", "unit_id")).join(u, "unit_id").join(queries.select("query_id", "query"), "query_id")
        return post.rerank(joined, self.score(F.col("query"), F.col("_shown")), k).select(*HITS)
