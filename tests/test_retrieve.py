import pytest
from pyspark.sql import functions as F

from docloom.errors import InvalidInput
from docloom.operators import retrieve
from docloom.operators.collection import Collection
from docloom.operators.fulltext import FullTextIndex
from docloom.providers import embed
from docloom.sources.cache import cached


@pytest.fixture(scope="module")
def units(spark):
    rows = [(1, "red fox in snow", 2020, None), (2, "blue whale in sea", 2021, None), (3, "red whale", 2022, "lod"), (4, "green tree", 2020, None)]
    return embed(spark.createDataFrame(rows, "unit_id long, content string, year int, mode string")).cache()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "red fox"), (2, "whale sea"), (3, "nothing here")], "query_id long, query string")


def first(hits):
    return {r.query_id: r.unit_id for r in hits.collect() if r["rank"] == 1}


def test_each_retriever(units, queries):
    vector = retrieve.VectorRetriever(Collection.in_memory(units))
    text = retrieve.FullTextRetriever(FullTextIndex(units, sortable=("year",)), mode="mode")
    assert first(vector.retrieve(queries, 2))[1] == 1
    hits = text.retrieve(queries, 5).collect()
    assert first(text.retrieve(queries, 5)) == {1: 1, 2: 2}
    assert all(0 < r.score < 1 for r in hits) and 3 not in {r.unit_id for r in hits}
    assert first(text.retrieve(queries, 5, {"year": {"$gt": 2020}})) == {2: 2}
    assert first(retrieve.FullTextRetriever(FullTextIndex(units, sortable=("year",))).retrieve(queries, 5, sort="year:desc")) == {1: 3, 2: 3}
    fused = retrieve.FusionRetriever([vector, text], "reciprocal_rank").retrieve(queries, 3)
    assert first(fused)[1] == 1 and fused.columns == list(retrieve.HITS)
    rewritten = retrieve.RewriteRetriever(text, lambda c: F.concat(c, F.lit(" tree")))
    assert {r.unit_id for r in rewritten.retrieve(queries.where("query_id = 3"), 3).collect()} == {4}
    top = retrieve.Reranker(head=["year"]).rerank(fused, queries, units, 1)
    assert first(top)[1] == 1
    with pytest.raises(InvalidInput):
        retrieve.FusionRetriever([])


def test_fuzzy(spark, units):
    q = spark.createDataFrame([(1, "whalle"), (2, "gren")], "query_id long, query string")
    assert first(retrieve.FullTextRetriever(FullTextIndex(units), fuzzy=True).retrieve(q, 3)) == {1: 3, 2: 4}


def test_contents_are_computed_once(spark, tmp_path):
    seen = []

    def compute(df):
        seen.append(df.count())
        return df.select("content_key", F.length("content").alias("n"))

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bb")], "id long, content string")
    for want in ([2], [2, 0]):
        assert {r.id: r.n for r in cached(rows, str(tmp_path / "c"), compute).collect()} == {1: 1, 2: 1, 3: 2}
        assert seen == want
