import pytest
from pyspark.sql import functions as F

from docloom.errors import InvalidInput
from docloom.operators import fusion, post


def hits(spark, *items):
    return spark.createDataFrame(list(items), "query_id string, retriever_idx int, pos int, unit_id string, score double")


def test_rrf_counts_ranks_from_zero_and_ignores_arrival(spark):
    rows = [("q", 0, 0, "a", 0.9), ("q", 0, 1, "b", 0.5), ("q", 1, 0, "b", 7.0), ("q", 1, 1, "c", None)]
    for order in (rows, rows[::-1]):
        got = {r.unit_id: r.score for r in fusion.reciprocal_rank(hits(spark, *order)).collect()}
        assert got == {"a": round(1 / 60, 6), "b": round(1 / 61 + 1 / 60, 6), "c": round(1 / 61, 6)}


def test_relative_score_of_equal_lists(spark):
    got = {r.unit_id: r.score for r in fusion.relative_score(hits(spark, ("q", 0, 0, "a", 2.0), ("q", 0, 1, "b", 2.0), ("q", 1, 0, "a", 0.0)), [1, 3]).collect()}
    assert got == {"a": 0.25, "b": 0.25}
    with pytest.raises(InvalidInput):
        fusion.relative_score(hits(spark), [0, 0])


def test_simple_takes_the_largest(spark):
    assert {r.unit_id: r.score for r in fusion.simple(hits(spark, ("q", 0, 0, "a", 0.1), ("q", 1, 0, "a", 0.4))).collect()} == {"a": 0.4}


def test_similarity(spark):
    df = hits(spark, ("q", 0, 0, "a", 0.7), ("q", 0, 1, "b", 0.69), ("q", 0, 2, "c", None))
    assert [r.unit_id for r in post.similarity_filter(df).collect()] == ["a"]
    with pytest.raises(InvalidInput):
        post.similarity_filter(df, 1.1)


def test_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("q", i, "x" * n, s) for i, (n, s) in enumerate([(40, 0.1), (400, 0.9), (4, 0.5)])], "query_id string, pos int, content string, score double")
    assert [r.pos for r in post.token_budget(df, 50, "truncate").orderBy("pos").collect()] == [0]
    assert [r.pos for r in post.token_budget(df, 101).orderBy("pos").collect()] == [1, 2]


def test_context(spark):
    units = spark.range(11).select(F.lit("d").alias("doc_id"), F.col("id").alias("seq"))
    h = spark.createDataFrame([("q", 0, "d", 2), ("q", 1, "d", 5), ("q", 2, "d", 7)], "query_id string, pos int, doc_id string, seq long")
    assert [r.seq for r in post.context_window(h, units).orderBy("pos", "shift").collect()] == [1, 2, 3, 4, 5, 6, 7, 8]
    assert post.context_window(h, units, 1, False).count() == 9


def test_tables_take_their_neighbours(spark):
    u = spark.createDataFrame([("d", i, t) for i, t in enumerate(["a", "<table>1", "<table>2", "b", "c"])], "doc_id string, seq int, content string")
    got = post.table_context(u, F.col("content").contains("<table")).orderBy("seq").collect()
    assert [r.content for r in got] == ["c"]  # both tables are neighbours of a table
    prev = post.table_context(u, F.col("content").contains("<table>1"), "prev").orderBy("seq").collect()
    assert [r.content for r in prev] == ["a\n\n<table>1", "<table>2", "b", "c"]


def test_rerank_text(spark):
    df = spark.createDataFrame([("x", None, "body"), ("x", "y", "b" * 3000)], "a string, b string, c string")
    got = [r[0] for r in df.select(post.rerank_text([F.col("a"), F.col("b")], F.col("c"))).collect()]
    assert got[0] == "[x]\nbody" and got[1].startswith("[x | y]\nb") and len(got[1]) == 2000


def test_pipeline_needs_a_step():
    with pytest.raises(InvalidInput):
        post.pipeline()
