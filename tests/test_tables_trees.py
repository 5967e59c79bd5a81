from pyspark.sql import functions as F

from docloom.operators import enrich, pages, tables, trees


def test_parsing():
    text = "x\n| a | b |\n|---|---|\n| 1 | 2 |\n| odd |\n| 3 | 4 |\n\n<table><tr><th rowspan='2'>h</th><th>i</th></tr><tr><td>1</td></tr></table>"
    pipe, html = tables.parse_text(text)
    assert pipe["columns"] == ["a", "b"] and pipe["rows"] == [["1", "2"], ["3", "4"]] and text[pipe["start"] :].startswith("| a")
    assert html["columns"] == ["h", "i"] and html["rows"] == [["h", "1"]] and html["is_complex"]
    assert tables.parse_text("no table") == []


def test_nested_heads():
    c, r, hard = tables.parse_html("<table><thead><tr><th colspan=2>t</th></tr><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td></tr></tbody></table>")
    assert (c, r, hard) == (["a", "b"], [["1", ""]], True)


def test_page_merge():
    t = lambda *rows: tables.table_html(["a"], [[x] for x in rows])
    assert tables.merge_pages(["intro\n" + t("1"), t("2") + "\nend"]) == "\n\n".join(["intro", t("1", "2"), "end"])
    assert tables.merge_pages([t("1"), "words\n" + t("2")]).count("<table>") == 2


def test_complexity(spark):
    df = spark.createDataFrame([("| a | b |\n| --- | --- |\n| x | x |",), ("| a | b |\n| --- | --- |\n|  | x |\n|  | y |",), ("| a | b |\n| --- | --- |\n| x | y |",)], "t string")
    assert [r[0] for r in df.select(tables.is_complex(F.col("t"))).collect()] == [True, True, False]


def test_merge_units(spark):
    u = spark.createDataFrame([(1, 0, "a", "c1", [2, 1], "p"), (1, 1, "b", None, [2], "q"), (2, 0, "x", None, None, "r")], "g int, seq int, content string, caption string, page_numbers array<int>, context_path string")
    got = {r.g: r for r in tables.merge_units("g", u).collect()}
    assert (got[1].content, got[1].caption, got[1].page_numbers, got[1].context_path) == ("a\n\nb", "c1", [1, 2], "p")
    assert got[2].page_numbers is None


def test_tree_summaries(spark):
    text = "lost\n# A\n" + "w " * 300 + "\n## B\nshort\n## C\ntext"
    nodes = trees.tree_nodes(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    got = {r.title: r.summary for r in trees.summaries(nodes).collect()}
    assert got["B"] == "## B\nshort"
    assert got["A"].startswith("# A\nw w") and got["A"].endswith("- C: ## C\ntext")


def test_mcts_finds_the_relevant_leaf():
    rows = [("0001", None, 0.1), ("0002", "0001", 0.2), ("0003", None, 0.6), ("0004", "0003", 0.9), ("0005", "0003", 0.0)]
    found = trees.mcts(rows, 40, 2)
    assert found[0][0] == "0004" and found == trees.mcts(rows, 40, 2)
    assert trees.mcts([], 10, 3) == []


def test_nested_round_trip():
    rows = [{"doc_id": 1, "node_id": "0001", "parent_id": None, "ord": 1, "level": 1, "title": "a"}, {"doc_id": 1, "node_id": "0002", "parent_id": "0001", "ord": 2, "level": 2, "title": "b"}]
    assert trees.from_nested(trees.to_nested(rows), 1) == rows


def test_node_ids(spark):
    assert spark.range(1).select(trees.node_ids(F.lit("first 0002, then 0010 and 0002; not 12345")).alias("x")).first().x == ["0002", "0010"]


def test_pages_are_found_again():
    texts = [f"Page {i} begins here. " + f"word{i} " * 60 for i in range(4)]
    text = "\n\n".join(texts)
    spans, at = [], 0
    for i, t in enumerate(texts):
        spans.append((i + 1, at, at + len(t)))
        at += len(t) + 2
    units = [texts[1], texts[2][:200].replace("word2", "word2,", 1), texts[3], "not there at all, by no means", None]
    assert pages.infer(units, [None] * 5, text, spans) == [[2], [3], [4], None, None]
    assert pages.infer(["anything"], [(0, 5)], text, spans) == [[1]]


def test_headings_are_marked_outside_tables():
    page = "| Intro | x |\n| --- | --- |\n\nIntro\ntext"
    assert enrich.correct_headings(page, [("Intro", 2)]) == "| Intro | x |\n| --- | --- |\n\n## Intro\ntext"


def test_heading_pieces_merge(spark):
    df = spark.createDataFrame([("d", 1, 1, "Chapter", 1, 0.0, 50.0, 10.0), ("d", 1, 2, "One", 1, 60.0, 90.0, 11.0), ("d", 1, 3, "Other", 1, 0.0, 40.0, 99.0)], "doc_id string, page int, span_no int, text string, level int, x0 double, x1 double, y double")
    assert sorted(r.text for r in enrich.merge_headings(df).collect()) == ["Chapter One", "Other"]


def test_compression_keeps_tables():
    table = "<table><tr><td>1</td></tr></table>"
    text = "\n\n".join(["A sentence of six words here. " * 30, table, "More words follow in this part. " * 30])
    out = enrich.compress(text, 60)
    assert table in out and len(out.split()) < 120
    assert enrich.compress("short", 60) == "short"


def test_answers(spark):
    q = spark.createDataFrame([("1", "red fox"), ("2", "none")], "query_id string, query string")
    h = spark.createDataFrame([("1", "u1", 0, "A red fox ran. Nothing else."), ("1", "u2", 1, "The fox.")], "query_id string, unit_id string, pos int, content string")
    rows = {r.query_id: r for r in enrich.prompts(q, h).select("query_id", "citations", enrich.extractive_answer(F.col("query"), F.col("context"), 1).alias("a")).collect()}
    assert rows["1"].citations == ["u1", "u2"] and "red fox" in rows["1"].a
    assert rows["2"].citations == [] and rows["2"].a == enrich.NO_CONTEXT
