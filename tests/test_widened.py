import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom import providers
from docloom.errors import ConfigError
from docloom.operators import enrich, graph, retrieve, tables, trees
from docloom.sources import office, readers

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("XML", ".xml").replace("RELS", ".xml.rels"), text)
    return out.getvalue()


def p(text, style=""):
    return f"<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


DOCX = archive(word__documentXML=f'<w:document {W}><w:body>{p("Top", "<w:pStyle w:val=\'Heading1\'/>")}{p("One &amp; two")}{p("item", "<w:numPr/>")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b|c")}</w:tc></w:tr><w:tr><w:tc>{p("1")}</w:tc></w:tr></w:tbl>{p("")}</w:body></w:document>')
PPTX = archive(ppt__slides__slide10XML=f'<s {A}><a:p><a:r><a:t>ten</a:t></a:r></a:p></s>', ppt__slides__slide2XML=f"<s {A}><a:p><a:r><a:t>two</a:t></a:r></a:p><a:tbl><a:tr><a:tc><a:p><a:r><a:t>x</a:t></a:r></a:p></a:tc></a:tr></a:tbl></s>")
XLSX = archive(
    xl__workbookXML=f'<workbook {S}><sheets><sheet name="First" r:id="r1"/></sheets></workbook>',
    xl___rels__workbookRELS='<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
    xl__sharedStringsXML=f"<sst {S}><si><t>name</t></si><si><r><t>pe</t></r><r><t>ar</t></r></si></sst>",
    xl__worksheets__sheet1XML=f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"/><c r="C2"><v>3.5</v></c></row></sheetData></worksheet>',
)


def test_office_files(spark, tmp_path):
    assert office.docx(DOCX) == "# Top\n\nOne & two\n\n- item\n\n| a | b\\|c |\n| --- | --- |\n| 1 |  |"
    assert office.pptx(PPTX) == "## Slide 1\n\ntwo\n\n| x |\n| --- |\n\n## Slide 2\n\nten"
    assert office.xlsx(XLSX) == "## First\n\n| name |  | n |\n| --- | --- | --- |\n| pear |  | 3.5 |"
    for kind, data in (("docx", DOCX), ("pptx", PPTX), ("xlsx", XLSX)):
        path = tmp_path / f"x.{kind}"
        path.write_bytes(data)
        r = readers.read(spark, str(path), kind).first()
        assert r.content == getattr(office, kind)(data) and r.metadata.mime_type.startswith("application/vnd.openxml") and r.metadata.file_type in ("word", "powerpoint", "excel")


def test_tree_retrievers(spark):
    text = "# Fruit\nall fruit\n## Apple\nred apple\n## Pear\ngreen pear\n# Sea\nblue sea"
    units = spark.createDataFrame([("u", [("high", text), ("low", "x")]), ("v", [("low", "y")])], "unit_id string, views array<struct<level:string,content:string>>")
    ask = spark.createDataFrame([(1, "apple fruit", "u"), (2, "pear", "v")], "query_id long, query string, unit_id string")
    for r in (trees.SimpleTree(), trees.SkeletonTree(2), trees.MctsTree("fast"), trees.MctsTree("explore")):
        got = r.retrieve(ask, units).collect()
        assert {x.query_id for x in got} == {1} and {"Fruit", "Apple"} <= {x.title for x in got}
    assert [x.title for x in trees.SimpleTree().retrieve(ask, units).orderBy("ord").collect()] == ["Fruit", "Apple"]
    answers = spark.createDataFrame([(1, "u", "first 0004, then 0001, 0004 and 9999")], "query_id long, doc_id string, answer string")
    named = trees.SkeletonTree().search(trees.trees_of(units), ask.withColumnRenamed("unit_id", "doc_id"), answers).orderBy("rank").collect()
    assert [x.node_id for x in named] == ["0004", "0001"]
    assert trees.PRESETS["accurate"] == (50, 1.0, 8)


def test_heading_correction(spark):
    pages = spark.createDataFrame([(1, 1, "Intro\ntext\n| Intro | x |"), (1, 2, "no heading"), (1, 3, None)], "doc_id long, page_number int, content string")
    heads = spark.createDataFrame([(1, 1, 0, "Intro", 2), (1, 1, 1, "absent", 1)], "doc_id long, page_number int, ord int, text string, level int")
    got = {r.page_number: r.content for r in enrich.correct_pages(pages, heads).collect()}
    assert got == {1: "## Intro\ntext\n| Intro | x |", 2: "no heading", 3: None}


def test_chunks_overlap():
    text = "a a a\n\nb b\n\nc c c\n\nd"
    assert enrich.overlapping_chunks(text, 5) == ["a a a\n\nb b", "b b\n\nc c c", "c c c\n\nd"]
    assert enrich.overlapping_chunks(text, 5, 0) == ["a a a\n\nb b", "c c c\n\nd"]
    assert all(len(c.split()) <= 3 for c in enrich.overlapping_chunks("one two three four. five six", 3))


def test_prompts(spark):
    q = spark.createDataFrame([("why", "because")], "q string, c string")
    assert q.select(enrich.filled("{{x}} Q: {query}\n{context}!", F.col("q"), F.col("c"))).first()[0] == "{x} Q: why\nbecause!"


def test_graph_lookups(spark):
    nodes = spark.createDataFrame([("p", "a", {"k": "1"}), ("p", None, {"k": "2"})], "label string, id string, props map<string,string>")
    made = graph.with_ids(nodes).collect()
    assert made[0].id == "a" and len(made[1].id) == 8 and graph.with_ids(nodes).collect() == made
    assert graph.get_node(nodes, "p", "a").count() == 1
    e = spark.createDataFrame([("p", "a", "p", "b", "R"), ("p", "c", "p", "a", "T")], "src_label string, src string, dst_label string, dst string, rel_type string")
    assert graph.related(e, "p", "a").count() == 1 and graph.related(e, "p", "a", "both").count() == 2
    assert graph.related(e, "p", "a", "both", "T").first().other == "c" and graph.related(e, "p", "a", "both", None, "b").count() == 1


def test_table_helpers(spark):
    df = spark.createDataFrame([("x\n| a |\n| b |\n\n| c |\ny | z", [["a", "b"], ["1"], []])], "t string, rows array<array<string>>")
    r = df.select(tables.pipe_blocks(F.col("t")).alias("b"), tables.even_rows(F.col("rows")).alias("e"), tables.first_row_as_head(F.col("rows")).alias("h")).first()
    assert r.b == ["| a |\n| b |\n", "| c |\n"] and r.e == [["a", "b"], ["1", ""], ["", ""]] and (r.h.columns, r.h.rows) == (["a", "b"], [["1"], []])
    assert tables.dangling("<tr><td><table></table>x</td></tr></table> rest") == ("<tr><td><table></table>x</td></tr>", " rest")
    assert tables.dangling("text") == ("", "text") and tables.dangling("<td>open") == ("<td>open", "")
    t = "<table><tr>1</tr><tr>2</tr><tr>3</tr></table>"
    assert tables.some_rows(t, 1, 1) == ["<tr>1</tr>", "<tr>3</tr>"] and len(tables.some_rows(t, 2, 2)) == 3
    assert tables.heading_before("# a\nx\n## b \ny", 13) == "b" and tables.heading_before("x", 1) is None


def test_providers_by_type_and_address(spark):
    units = spark.createDataFrame([(1, "text", "a b"), (2, "image", "c"), (3, None, "d")], "unit_id long, unit_type string, content string")
    got = {r.unit_id: r.embedding for r in providers.embed_by_type(units, {"text": "offline/words", "image": "offline@~:words?dim=8"}).collect()}
    assert len(got[1]) == 64 and len(got[2]) == 8 and got[3] is None
    assert providers.dimension("offline@~:words?dim=8") == 8
    with pytest.raises(ConfigError):
        providers.reranker("nobody/x")
    providers.register_reranker("Lengths", lambda a: lambda q, t: F.length(t).cast("double"))
    hits = spark.createDataFrame([(1, 1, 0.0, 1), (1, 2, 0.0, 2)], "query_id long, unit_id long, score double, rank int")
    found = retrieve.Reranker("lengths/any").rerank(hits, spark.createDataFrame([(1, "q")], "query_id long, query string"), units, 1)
    assert [r.unit_id for r in found.collect()] == [1]
