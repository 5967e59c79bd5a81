"""Steps whose cost or state once grew faster than their input."""

import difflib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom import folders
from docloom.operators import collection, enrich, fulltext, pages, search, tables
from docloom.plans import queries
from docloom.workers import map_arrow


def _long_table(spark, n):
    row = F.format_string("| %d | a |", F.col("id"))
    text = F.concat(F.lit("Before.\n\n| k | v |\n| --- | --- |\n"), F.array_join(F.array_sort(F.collect_list(F.struct("id", row.alias("r"))))["r"], "\n"), F.lit("\n\nAfter."))
    return spark.range(n).agg(text.alias("text"))


def test_a_long_pipe_table_is_found_and_parsed(spark):
    n = 30_000
    t = _long_table(spark, n).select(F.explode(tables.pipe_tables(F.col("text"))).alias("t")).select(tables.parse_pipe(F.col("t")).alias("p")).select("p.*")
    r = t.select("columns", F.size("rows").alias("n"), F.get("rows", F.lit(n - 1)).alias("last")).first()
    assert (r["columns"], r["n"], r["last"]) == (["k", "v"], n, [str(n - 1), "a"])


def test_a_long_table_is_summarised(spark):
    n = 30_000
    t = _long_table(spark, n).select(tables.parse_pipe(F.get(tables.pipe_tables(F.col("text")), F.lit(0))).alias("p")).select("p.*")
    r = t.select(enrich.summarise_table(F.col("columns"), F.col("rows")).alias("s"), enrich.is_data_critical(F.col("columns"), F.col("rows")).alias("c")).first()
    assert r["s"].startswith("k: 0, v: a; k: 1, v: a; ") and r["s"].count(";") == n - 1 and r["c"]


def test_long_blocks_and_uneven_rows(spark):
    n = 30_000
    text = _long_table(spark, n)
    assert text.select(F.size(tables.pipe_blocks(F.col("text"))).alias("n")).first()["n"] == 1
    rows = spark.range(n).agg(F.collect_list(F.array_repeat(F.lit("x"), (F.col("id") % 3 + 1).cast("int"))).alias("rows"))
    assert rows.select(F.array_distinct(F.transform(tables.even_rows(F.col("rows")), lambda r: F.size(r))).alias("n")).first()["n"] == [3]


def test_short_tables_are_parsed_as_before(spark):
    df = spark.createDataFrame([("",), ("| a |",), ("| a |\n| - |",), (None,)], "t string")
    assert [r["p"] for r in df.select(tables.parse_pipe(F.col("t")).alias("p")).collect()] == [None] * 4


def test_a_brand_of_many_parts(spark, tmp_path):
    n = 30_000
    spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("Brand#11").alias("p_brand"), F.concat(F.lit("name "), "id").alias("p_name"), F.lit("type").alias("p_type")).write.parquet(str(tmp_path / "part.parquet"))
    r = queries.QUERIES["table_parse_md"](spark, str(tmp_path))
    assert r.where("row_no = key AND name = 'name ' || key").count() == r.count() == n


def _corpus(spark, n=300):
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.7)) % 40}" for _ in range(n * 8)]
    docs = [(f"d{i}", " ".join(words[i * 8 : i * 8 + rng.randrange(9)])) for i in range(n)] + [("empty", ""), ("none", None), ("marks", "Ärger... W1,w2")]
    asked = [(f"q{i}", " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(4)))) for i in range(600)] + [("null", None)]
    return docs, asked, spark.createDataFrame(docs, "doc_id string, text string").repartition(3), spark.createDataFrame(asked, "query_id string, query string")


def _brute(docs, asked, bm25):
    split = lambda t: [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split()]
    texts = {d: split(t) for d, t in docs}
    mean, n = sum(map(len, texts.values())) / len(texts), len(texts)
    df = {w: sum(w in t for t in texts.values()) for t in texts.values() for w in t}
    weight = lambda w, t: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) if bm25 else 1.0
    return {q: {d: sum(weight(w, t) for w in set(split(x)) & set(t)) for d, t in texts.items() if set(split(x)) & set(t)} for q, x in asked}


@pytest.mark.parametrize("turns", [1, 5])
@pytest.mark.parametrize("bm25", [True, False])
def test_search_by_blocks_is_brute_force(spark, monkeypatch, turns, bm25):
    docs, asked, d, q = _corpus(spark)
    wanted = fulltext.query_terms(q)
    if turns > 1:
        monkeypatch.setattr(fulltext, "ASKED_BYTES", 12_000)
    some = fulltext.asked(wanted, "query_id", 3)
    assert len(some) >= turns and (turns > 1 or len(some) == 1)
    index, want = fulltext.postings(d), _brute(docs, asked, bm25)
    got = {(r.query_id, r.doc_id): r.score for r in fulltext.scored(index, wanted, bm25=bm25).collect()}
    assert got == pytest.approx({(x, y): s for x, hits in want.items() for y, s in hits.items()}, abs=2e-6)
    best = {(r.query_id, r["rank"]): r.doc_id for r in fulltext.top(index, wanted, 3, bm25=bm25, some=some).collect()}
    assert best == {(x, i + 1): y for x, hits in want.items() for i, y in enumerate(sorted(hits, key=lambda y: (-round(hits[y], 6), y))[:3])}


def test_a_search_for_nothing(spark):
    _, _, d, q = _corpus(spark, 5)
    index = fulltext.FullTextIndex(d, "doc_id", "text")
    assert index.search(q.limit(0)).isEmpty() and index.search(q.where("query IS NULL")).isEmpty()
    assert fulltext.FullTextIndex(d.limit(0), "doc_id", "text").search(q).isEmpty()


@pytest.mark.parametrize("name", ["fusion_simple", "fusion_relative", "fusion_rrf", "fulltext_sorted", "fulltext_index_changes", "answer_extractive", "rerank_lexical", "fulltext_bm25", "select_excerpts", "fulltext_facets", "query_rewrite"])
def test_what_a_search_keeps_is_a_row_for_each_document(spark, data, monkeypatch, name):
    kept = []
    monkeypatch.setattr(fulltext, "cut", lambda df: kept.append(folders.cut(df)) or kept[-1])
    queries.QUERIES[name](spark, data).count()
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    assert kept and all(df.count() <= n for df in kept)


def test_only_terms_that_may_be_keywords_are_passed_on(spark, monkeypatch):
    rng = random.Random(2)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.5)) % 500}" for _ in range(rng.randrange(60)))) for i in range(400)]
    df = {}
    for _, t in docs:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    weight = lambda w, t: -round(t.split().count(w) * math.log(len(docs) / df[w]), 6)
    want = {i: sorted(set(t.split()), key=lambda w: (weight(w, t), w))[:5] for i, t in docs if t}
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for common in (0, 1, 50, 1000):
        monkeypatch.setattr(enrich, "COMMON", common)
        assert {r.doc_id: r.keywords for r in enrich.keywords(rows).collect()} == want
    made = []
    monkeypatch.setattr(enrich, "map_arrow", lambda *a: made.append(map_arrow(*a)) or made[-1])
    enrich.keywords(rows)
    assert made[0].count() < sum(df.values()) / 2


@pytest.mark.parametrize("metric", ["l2_inverse", "cosine"])
@pytest.mark.parametrize("most", [1 << 26, 20_000])
def test_tied_vectors_are_not_kept(spark, monkeypatch, metric, most):
    rng = np.random.default_rng(3)
    x = rng.integers(-1, 2, size=(2600, 3)).astype(float)  # 27 vectors, each about 96 times
    x = x[np.abs(x).sum(axis=1) > 0]
    df = spark.createDataFrame([(f"v{i}", [float(v) for v in row]) for i, row in enumerate(x)], "vec_id string, embedding array<float>").repartition(2)
    monkeypatch.setattr(search, "BROADCAST_BYTES", most)
    made = []
    monkeypatch.setattr(search, "map_arrow", lambda *a: made.append(map_arrow(*a)) or made[-1])
    asked = df.where("vec_id < 'v15'").withColumnRenamed("vec_id", "query_id")
    got = search.knn(asked, df, 4, metric)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    n = np.sqrt((x * x).sum(axis=1))
    s = np.round(x @ x.T / (n[:, None] * n[None]) if metric == "cosine" else 1 / (1 + d), 6)
    names = [f"v{i}" for i in range(len(x))]
    want = {(q, names[v], r + 1) for i, q in enumerate(names) if q < "v15" for r, v in enumerate(sorted(range(len(x)), key=lambda j: (-s[i, j], names[j]))[:4])}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got.collect()} == want
    pieces = spark.sparkContext.defaultParallelism
    assert made[-1].count() <= 4 * asked.count() * pieces


def test_order_of_ids():
    import pyarrow as pa

    from docloom.operators.ranks import codes, leading

    assert codes(pa.array(["v10", "v9", None, "ä"])).argsort().tolist() == [2, 0, 1, 3]
    assert codes(pa.array([1.0, float("nan"), None, -2.0])).argsort().tolist() == [2, 3, 0, 1]
    assert codes(pa.array([True, False])).argsort().tolist() == [1, 0]
    assert codes(pa.array([{"a": 1}, {"a": 2}])).tolist() == [0, 0]
    row, key = np.array([0, 0, 0, 1]), np.array([1.0, 1.0, 2.0, 0.0])
    assert sorted(leading(row, key, np.array([2, 1, 3, 0]), 2)) == [1, 2, 3]
    assert sorted(leading(row, key, np.zeros(4), 2)) == [0, 1, 2, 3]  # ties that stay open are kept


def test_tied_vectors_within_a_filter(spark):
    df = spark.createDataFrame([(i, [1.0, float(i % 2)], i % 5) for i in range(300)], "vec_id long, embedding array<float>, label int").repartition(3)
    got = collection.Collection.in_memory(df, "vec_id").search(df.where("vec_id < 2").withColumnRenamed("vec_id", "query_id"), 3, {"label": {"$gte": 2, "$nin": [4]}}).collect()
    assert {(r.query_id, r["rank"]): r.vec_id for r in got} == {(0, 1): 2, (0, 2): 8, (0, 3): 12, (1, 1): 3, (1, 2): 7, (1, 3): 13}


def test_exact_text_is_not_compared_letter_by_letter(monkeypatch):
    texts = [f"Page {i} begins here. " + f"word{i} " * 60 for i in range(4)]
    text = "\n\n".join(texts)
    monkeypatch.setattr(pages, "alike", None)
    assert [pages.fuzzy_find(t, text) for t in texts] == [text.index(t) for t in texts]
    assert pages.fuzzy_find("## Page 0", "## Page 0") is None  # too short
    assert pages.fuzzy_find("#" * 60 + " a", "x" * 10 + "#" * 60 + " a") == 10


def test_page_numbers_of_odd_documents(spark):
    kind = "array<struct<page_number: int, span: struct<start: int, end: int>>>"
    docs = spark.createDataFrame([(1, "first page\n\nsecond page", [(1, (0, 10)), (2, (12, 23))]), (2, None, None), (None, "lost and found", [(7, (0, 14))])], f"doc_id long, content string, pages {kind}")
    units = spark.createDataFrame([(1, 1, "second page", None, None), (1, 0, None, 0, 10), (2, 0, "nothing of this", None, None), (3, 0, "no such document", None, None), (None, 0, "lost and found", None, None)], "doc_id long, seq int, content string, start int, end int")
    got = {(r.doc_id, r.seq): r.page_numbers for r in pages.infer_page_numbers(units, docs).collect()}
    assert got == {(1, 0): [1], (1, 1): [2], (2, 0): None, (None, 0): [7]}


def test_alike_is_the_ratio_of_difflib():
    rng = random.Random(4)
    for _ in range(300):
        a = "".join(rng.choice("abc ä") for _ in range(rng.randrange(60)))
        b = "".join(c for c in a if rng.random() < 0.8) + a[: rng.randrange(9)] if rng.random() < 0.7 else a[::-1]
        ratio = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert pages.alike(a, b) == ratio and pages.alike(a, b, 0.7) in ((ratio,) if ratio >= 0.7 else (ratio, 0.0))


def test_documents_are_not_embedded_for_the_text_index(spark, data, monkeypatch):
    made = []
    monkeypatch.setattr(fulltext, "map_arrow", lambda df, *a: made.append(df) or map_arrow(df, *a))
    queries.QUERIES["retrieve_fused"](spark, data)
    assert made and not any("Join" in df._jdf.queryExecution().optimizedPlan().toString() for df in made)  # with the vectors
