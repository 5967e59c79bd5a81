import pytest
from pyspark.sql import functions as F

from docloom import providers
from docloom.errors import ConfigError, MissingResource
from docloom.functions import text as tx
from docloom.operators import documents, graph
from docloom.sources import readers
from docloom.streaming.ingest import stream_upsert


def test_html():
    page = "<html><head><title>t</title><style>p{}</style></head><body><h1>Head</h1><p>One <b>two</b>&amp;</p><ul><li>x</li></ul><script>no()</script></body></html>"
    assert readers.html_to_markdown(page) == "# Head\nOne two&\n- x"


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\ntext")
    r = readers.read(spark, str(tmp_path), "markdown").first()
    assert r.content == "# T\ntext" and r.metadata.file_type == "markdown" and r.metadata.file_size == 8 and r.pages[0].span.end == 8
    assert readers.read(spark, str(tmp_path), "markdown_tree").first().title == "T"
    with pytest.raises(MissingResource):
        readers.read(spark, str(tmp_path), "pdf")


def test_known_hash(spark):
    assert spark.createDataFrame([("abc",), (None,)], "t string").select(tx.xxh64_hex("t").alias("h")).collect()[0].h == "44bc2cf5ad770999"


def test_normalize():
    assert tx.plain_text("## A  *b*\n<i>c</i> ﬁ __d__") == "A b c fi d"


@pytest.mark.parametrize(("pages", "label"), [(None, "N/A"), ([], "N/A"), ([3], "p3"), ([2, 1], "p1-2"), ([1, 3, 5], "p1,3,5")])
def test_page_labels(spark, pages, label):
    assert spark.createDataFrame([(pages,)], "p array<int>").select(tx.page_label(F.col("p")).alias("l")).first().l == label


@pytest.mark.parametrize("uri", ["offline/words", "http@host:8080:model?dim=8", "offline@~:words?dim=16"])
def test_addresses_round_trip(uri):
    a = providers.parse_address(uri)
    assert providers.parse_address(str(a)) == a


@pytest.mark.parametrize("uri", ["", "nothing", "a/b?c=1", "a@b"])
def test_bad_addresses(uri):
    with pytest.raises(ConfigError):
        providers.parse_address(uri)


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id long, content string")
    got = {r.id: r.embedding for r in providers.embed(df, "offline@~:words?dim=8").collect()}
    assert got[1] == got[2] and len(got[1]) == 8 and abs(sum(x * x for x in got[1]) - 1) < 1e-6


class FirstWords(providers.HashedWords):
    most_tokens = 3


def test_long_texts_are_embedded_whole(spark):
    head = " ".join(f"w{i}" for i in range(8000))
    df = spark.createDataFrame([(1, head), (2, head + " and" + " more" * 500)], "id long, content string")
    got = {r.id: r.embedding for r in providers.embed(df).collect()}
    whole = providers.provider("offline/words").embed([r.content for r in df.orderBy("id").collect()])
    assert got[1] == whole[0].tolist() and got[2] == whole[1].tolist() and got[1] != got[2]


def test_only_providers_with_a_limit_have_texts_cut():
    address = providers.parse_address("offline/words")
    assert providers.within_limit(FirstWords(address), ["a b c d", "a b"]) == ["a b c", "a b"]
    assert providers.within_limit(providers.HashedWords(address), ["a " * 9000]) == ["a " * 9000]


def test_requests_are_bounded():
    assert providers.batches([5, 5, 5, 20, 1], 10, 2) == [[0, 1], [2], [3], [4]]


def test_retries():
    calls = []

    @providers.retried(3, delay=0)
    def f():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError
        return "ok"

    assert f() == "ok" and len(calls) == 3


def test_archive(spark, tmp_path):
    d = documents.from_text(spark.createDataFrame([("x", "hello")], "doc_id string, text string"))
    documents.dump(d, None, str(tmp_path / "a"))
    back, none = documents.load(spark, str(tmp_path / "a"))
    assert back.first() == d.first() and none is None
    assert back.select(documents.get_page(F.col("pages"), 1)["content"].alias("c")).first().c == "hello"


def test_graph_updates(spark):
    n = spark.createDataFrame([("a", "1", {"x": "1", "y": "2"})], "label string, id string, props map<string,string>")
    c = spark.createDataFrame([("a", "1", {"y": "3"})], "label string, id string, props map<string,string>")
    assert graph.update_nodes(n, c).first().props == {"x": "1", "y": "3"}
    r = spark.createDataFrame([("u", "parent", "p1", 1), ("u", "parent", "p2", 2), ("u", "references", "z", 1)], "src string, rel string, dst string, n int")
    assert {(x.rel, x.dst) for x in graph.single_valued(r, "n").collect()} == {("parent", "p2"), ("references", "z")}
    assert graph.as_map(r.select("src", "rel", "dst")).first().relations == {"parent": ["p1", "p2"], "references": ["z"]}


def test_stream_in_batches(spark, tmp_path):
    from docloom.operators.collection import Collection

    for k in range(3):
        spark.createDataFrame([(k, "old"), (9, f"v{k}")], "unit_id long, content string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    c = Collection.local(spark, str(tmp_path / "c"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for _ in range(2):  # a second run finds nothing new
        stream_upsert(spark, str(tmp_path / "in"), schema, c, str(tmp_path / "cp"), files_per_batch=1).awaitTermination()
    assert {r.unit_id for r in c.rows.collect()} == {0, 1, 2, 9} and c.count() == 4
