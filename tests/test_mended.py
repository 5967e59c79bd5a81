"""What was once wrong."""

import pytest
from pyspark.sql import functions as F

from docloom.errors import StepFailed
from docloom.functions import text as tx
from docloom.operators import collection, fulltext, graph, retrieve, split, tables
from docloom.providers import embed


def test_vectors_of_units_with_string_ids(spark):
    docs = spark.createDataFrame([(1, "red apples and pears"), (2, "the blue sea"), (3, None)], "doc_id long, text string")
    units = embed(split.chain(split.as_units(docs)).where("content IS NOT NULL"))
    found = retrieve.VectorRetriever(collection.Collection.in_memory(units)).retrieve(spark.createDataFrame([(7, "blue sea")], "query_id long, query string"), 1)
    assert found.join(units, "unit_id").select("doc_id").first().doc_id == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_tables_are_units_of_their_own():
    text = "one two three\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\nfour five six"
    assert split.split_text(text, 12) == ["one two three", "| a | b |\n| --- | --- |\n| 1 | 2 |", "four five six"]


def test_tables_inside_tables():
    inner = "<table><tr><td>x</td></tr></table>"
    text = f"a <table><tr><th>h</th><th>i</th></tr><tr><td>{inner}</td><td>y</td></tr><tr><td>1</td><td>2</td></tr></table> b"
    assert [text[slice(*s)] for s in tx.html_tables(text)] == [text[2:-2]]
    (got,) = tables.parse_text(text)
    assert got["columns"] == ["h", "i"] and len(got["rows"]) == 2 and got["rows"][0][1] == "y"
    assert tx.html_tables("<table><tr>" + inner) == [(11, 11 + len(inner))] and tx.html_tables("</table>") == []


def test_tags_leave_nothing():
    assert tx.plain_text("a<b>c</b>d") == "acd"


def test_paths_go_on_at_the_same_label(spark):
    e = spark.createDataFrame([("customer", "c1", "OF", "nation", "1"), ("region", "1", "IN", "world", "w")], "src_label string, src string, rel_type string, dst_label string, dst string")
    assert graph.match_path(e, "OF", "IN").isEmpty()
    assert graph.match_path(e.union(spark.createDataFrame([("nation", "1", "IN", "world", "w")], e.schema)), "OF", "IN").count() == 1


def test_edges_differ_by_properties(spark):
    nodes = spark.createDataFrame([("n", "a"), ("n", "b")], "label string, id string")
    schema = "src_label string, src string, dst_label string, dst string, rel_type string, props map<string,string>"
    e = spark.createDataFrame([("n", "a", "n", "b", "R", {"k": "1"}), ("n", "a", "n", "b", "R", {"k": "2"}), ("n", "a", "n", "b", "R", {"k": "1"})], schema)
    assert graph.create_edges(e, nodes).count() == 2


def test_a_cell_goes_on_and_the_others_stay():
    head, tail = "<table><tr><th>a</th><th>b</th><th>c</th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>", "<table><tr><th>more</th></tr></table>"
    got = tables.merge_pages([head, tail], decide=lambda a, b: "continue_cell")
    assert "<td>1 more</td><td>2</td><td>3</td>" in got


def test_repeated_keys_of_an_upsert(spark):
    one = spark.createDataFrame([(1, "a")], "unit_id long, content string")
    assert collection.upsert(one, spark.createDataFrame([(2, "b"), (2, "c")], one.schema)).count() == 2


def test_versions_of_a_collection(spark, tmp_path):
    schema = "unit_id long, content string"
    c = collection.Collection.local(spark, str(tmp_path / "c"))
    c.add(spark.createDataFrame([(1, "a"), (1, "b")], schema))
    assert c.count() == 1
    for k in range(5):
        c.add(spark.createDataFrame([(k, "x")], schema))
    assert c.count() == 5 and len(list((tmp_path / "c" / "data").iterdir())) == collection.Collection.KEEP
    (tmp_path / "c" / "claims" / f"{7:012d}").touch()  # another writer was faster
    with pytest.raises(StepFailed):
        c.add(spark.createDataFrame([(9, "x")], schema))
    assert c.count() == 5 and len(list((tmp_path / "c" / "data").iterdir())) == collection.Collection.KEEP


def test_an_index_lives_on(spark):
    rows = spark.createDataFrame([(1, "red pears", 5), (2, "blue sea", 5), (3, "red sea", 6)], "unit_id long, content string, doc_id long")
    ask = spark.createDataFrame([(0, "red")], "query_id long, query string")
    ids = lambda i: sorted(r.unit_id for r in i.search(ask).collect())
    index = fulltext.FullTextIndex(rows)
    assert ids(index) == [1, 3] and index.count() == 3 and index.exists(2) and not index.exists(9)
    assert ids(index.delete(spark.createDataFrame([(1,)], "unit_id long"))) == [3]
    assert ids(index.delete_by_doc_id(spark.createDataFrame([(6,)], "doc_id long"))) == [1]
    more = index.upsert(spark.createDataFrame([(2, "red again", 7), (4, "red red", 8)], rows.schema))
    assert ids(more) == [1, 2, 3, 4] and ids(more.update(spark.createDataFrame([(1, "green", 5), (9, "red", 5)], rows.schema))) == [2, 3, 4]
    fresh = {r.unit_id: r.score for r in fulltext.FullTextIndex(more.rows).search(ask).collect()}
    assert {r.unit_id: r.score for r in more.search(ask).collect()} == fresh
    assert index.clear().search(ask).isEmpty() and index.search(ask, condition={"doc_id": 6}).first().unit_id == 3


def test_headings_by_document(spark):
    text = "\n".join(f"{'#' * (1 + i % 3)} h{i}\nbody {i}" for i in range(2000))
    got = split.split_headers(split.as_units(spark.createDataFrame([(1, text)], "doc_id long, text string"))).orderBy(F.desc("seq")).first()
    assert got.seq == 1999 and got.context_path == "h1998 > h1999"
