"""One query for each operator over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import few, scratch
from ..functions import text as tx
from ..operators import collection, documents, enrich, filters, fulltext, fusion, graph, pages, post, retrieve, search, split, tables, trees
from ..providers import embed
from ..sources import readers
from ..streaming.ingest import stream_upsert
from ..workers import importable
from .synthetic import CHATS_SQL, chats_markdown, table, turns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return add


# Vector search


def _knn_sql(score: str, where: str = "true") -> str:
    return f"""SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (
      SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT q.vec_id AS query_id, b.vec_id, round({score}, 6) AS score FROM embeddings q, embeddings b WHERE {where})) WHERE rank <= 10"""


COSINE_SQL = "list_cosine_similarity(b.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumnRenamed("vec_id", "query_id")


@query(_knn_sql(COSINE_SQL))
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.knn(_queries(spark, d), table(spark, d, "embeddings"))


@query(_knn_sql("1 / (1 + list_sum(list_transform(list_zip(b.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))))"))
def vector_l2_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.knn(_queries(spark, d), table(spark, d, "embeddings"), metric="l2_inverse")


@query(_knn_sql(COSINE_SQL, "b.label >= 2 AND b.label NOT IN (4)"))
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return collection.Collection.in_memory(e, "vec_id").search(_queries(spark, d), condition={"label": {"$gte": 2, "$nin": [4]}})


@query("""WITH e AS (SELECT 'v' || vec_id AS unit_id, embedding FROM embeddings) SELECT query_id, unit_id, score, CAST(rank AS INTEGER) AS rank FROM (
      SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM (
        SELECT q.unit_id AS query_id, b.unit_id, round(list_cosine_similarity(b.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM e q, e b)) WHERE rank <= 10""")
def vector_topk_string_ids(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("unit_id"), "embedding")
    return collection.Collection.in_memory(units).search(units.withColumnRenamed("unit_id", "query_id"))


# Collections


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("unit_id"), F.col("c_name").alias("content"), F.col("c_acctbal").alias("score"))


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit_id"), F.col("s_name").alias("content"), F.col("s_acctbal").alias("score"))


@query("""SELECT s_suppkey AS unit_id, s_name AS content, s_acctbal AS score FROM supplier
  UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def collection_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = collection.Collection.in_memory(_customers(spark, d))
    c.add(_suppliers(spark, d))
    return c.rows


@query("""SELECT c_custkey AS unit_id, coalesce(s_name, c_name) AS content, coalesce(s_acctbal, c_acctbal) AS score FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def collection_update(spark: SparkSession, d: str) -> DataFrame:
    return collection.update(_customers(spark, d), _suppliers(spark, d))


@query("SELECT c_custkey AS unit_id, c_name AS content, c_acctbal AS score FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def collection_delete(spark: SparkSession, d: str) -> DataFrame:
    return collection.delete(_customers(spark, d), table(spark, d, "orders").select(F.col("o_custkey").alias("unit_id")))


@query("SELECT c_custkey AS unit_id, c_name AS content, c_acctbal AS score FROM customer WHERE NOT coalesce(c_acctbal < 1000, false)")
def collection_remove_filter(spark: SparkSession, d: str) -> DataFrame:
    return collection.remove(_customers(spark, d), {"score": {"$lt": 1000}})


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE value END AS value, CASE WHEN event_type = 'error' THEN 'high' ELSE event_type END AS level, user_id FROM events""")
def collection_patch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type", "value", F.struct(F.col("event_type").alias("level"), "user_id").alias("meta"))
    return collection.patch(e, {"event_type": "error"}, {"value": 0.0, "meta.level": "high"}).select("event_id", "value", F.col("meta.level").alias("level"), F.col("meta.user_id").alias("user_id"))


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('error', 'click') AND value > 10")
def collection_fetch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    return collection.fetch(e, {"event_type": {"$in": ["error", "click"]}, "value": {"$gt": 10}}, order=("event_id",))


@query("SELECT event_type, count(*) AS n FROM events WHERE value >= 5 GROUP BY event_type")
def collection_count(spark: SparkSession, d: str) -> DataFrame:
    return filters.where(table(spark, d, "events"), {"value": {"$gte": 5}}).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT 'customer' AS kind, c_custkey AS id, CAST(('0x' || substr(sha256(c_name), 1, 16))::UBIGINT % 9223372036854775808::UBIGINT AS BIGINT) AS point FROM customer")
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), tx.point_id(F.col("c_name")).alias("point"))


# Filters


def _filter(name: str, source: str, key: str, condition: dict, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return filters.where(table(spark, d, source), condition).select(key)

    run.__name__ = name
    query(f"SELECT {key} FROM {source} WHERE {sql}")(run)


_filter("filter_eq_ne", "events", "event_id", {"event_type": "error", "user_id": {"$ne": 8}}, "event_type = 'error' AND user_id IS DISTINCT FROM 8")
_filter("filter_range", "orders", "o_orderkey", {"o_totalprice": {"$gte": 1000, "$lt": 50000.5}}, "o_totalprice >= 1000 AND o_totalprice < 50000.5")
_filter("filter_in_nin", "customer", "c_custkey", {"c_mktsegment": {"$in": ["BUILDING", "HOUSEHOLD"]}, "c_nationkey": {"$nin": [1, 2, 3]}}, "c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AND c_nationkey NOT IN (1, 2, 3)")
_filter(
    "filter_and_or", "events", "event_id", {"$or": [{"$and": [{"event_type": "click"}, {"value": {"$gt": 20}}]}, {"user_id": {"$lte": 5}}]}, "(event_type = 'click' AND value > 20) OR user_id <= 5"
)
_filter("filter_nor_not", "orders", "o_orderkey", {"$nor": [{"o_orderstatus": "F"}, {"o_totalprice": {"$lt": 9000}}], "$not": {"o_orderpriority": "5-LOW"}}, "NOT (o_orderstatus = 'F' OR o_totalprice < 9000) AND NOT o_orderpriority = '5-LOW'")
_filter("filter_json_path", "events", "event_id", {"metadata.custom.props.k": {"$gte": 50}}, "CAST(json_extract(props, '$.k') AS DOUBLE) >= 50")


# Full text

TERMS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"


def _bm25_ctes(query_text: str = "text") -> str:
    return f"""d AS (SELECT doc_id, {TERMS.format("text")} AS t FROM documents),
  q AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS.format(query_text)}) AS term FROM benchmark),
  st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
  f AS (SELECT doc_id, term, count(*) AS tf, min(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
  df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
  h AS (SELECT q.query_id, f.doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
    FROM f JOIN df USING (term) JOIN q USING (term), st GROUP BY q.query_id, f.doc_id)"""


def _best_sql(k: int = 10, order: str = "score DESC", source: str = "h") -> str:
    return f"SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, doc_id) AS rank FROM {source}) WHERE rank <= {k}"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _best(spark: SparkSession, d: str, k: int) -> DataFrame:
    return few(fulltext.bm25(table(spark, d, "documents"), _items(spark, d), k))


@query(f"WITH {_bm25_ctes()} {_best_sql()}")
def fulltext_bm25(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.bm25(table(spark, d, "documents"), _items(spark, d)).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {_bm25_ctes()} {_best_sql(order='n_chars DESC', source='(SELECT h.*, n_chars FROM h JOIN documents USING (doc_id))')}")
def fulltext_sorted(spark: SparkSession, d: str) -> DataFrame:
    index = fulltext.FullTextIndex(table(spark, d, "documents"), "doc_id", "text", ("n_chars",))
    return index.search(_items(spark, d), sort="n_chars:desc").select("query_id", "doc_id", "score", "rank")


@query(f"""WITH documents AS (SELECT doc_id, CASE WHEN doc_id % 7 = 2 THEN upper(lang) || ' again' ELSE text END AS text FROM main.documents WHERE doc_id % 5 <> 1), {_bm25_ctes()} {_best_sql()}""")
def fulltext_index_changes(spark: SparkSession, d: str) -> DataFrame:
    """An index with documents added, replaced and deleted after a first search, searched again."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    index = fulltext.FullTextIndex(docs.where("doc_id % 3 > 0"), "doc_id", "text")
    index.search(_items(spark, d).limit(1)).count()
    index = index.upsert(docs.where("doc_id % 3 = 0")).update(docs.where("doc_id % 7 = 2").withColumn("text", F.concat(F.upper("lang"), F.lit(" again"))))
    index = index.delete(docs.where("doc_id % 5 = 1").select("doc_id"))
    return index.search(_items(spark, d)).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {_bm25_ctes()} SELECT query_id, lang AS value, count(*) AS n FROM h JOIN documents USING (doc_id) GROUP BY query_id, lang")
def fulltext_facets(spark: SparkSession, d: str) -> DataFrame:
    wanted = fulltext.query_terms(_items(spark, d))
    some = fulltext.asked(wanted, "query_id")
    index = fulltext.postings(table(spark, d, "documents"), vocabulary=fulltext.vocabulary_of(some), keep=("lang",))
    return fulltext.facets(index, wanted, "lang", some=some)


@query(f"""WITH q AS (SELECT DISTINCT unnest({TERMS.format("text")}) AS term FROM benchmark),
  v AS (SELECT DISTINCT unnest({TERMS.format("text")}) AS word FROM documents),
  cq AS (SELECT term, unnest(list_distinct(list_concat([term], CASE WHEN length(term) >= 4 THEN list_transform(range(1, length(term) + 1), lambda i: substr(term, 1, i - 1) || substr(term, i + 1)) ELSE [] END))) AS cut FROM q),
  cv AS (SELECT word, unnest(list_distinct(list_concat([word], CASE WHEN length(word) >= 4 THEN list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1)) ELSE [] END))) AS cut FROM v)
  SELECT DISTINCT term, word, CAST(levenshtein(term, word) AS INTEGER) AS distance FROM cq JOIN cv USING (cut)
  WHERE levenshtein(term, word) <= 1 AND (term = word OR (length(term) >= 4 AND length(word) >= 4))""")
def fulltext_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = table(spark, d, "documents").select(F.explode(tx.terms(F.col("text"))).alias("word"))
    return fulltext.spelling_variants(fulltext.query_terms(_items(spark, d)), vocabulary)


# Fusion: BM25 and the number of the query's terms that a document has

LISTS_SQL = f"""{_bm25_ctes()}, c AS (SELECT query_id, doc_id, CAST(count(*) AS DOUBLE) AS score FROM f JOIN q USING (term) GROUP BY query_id, doc_id),
  l AS (SELECT 0 AS i, query_id, doc_id, score, rank FROM ({_best_sql(20)}) UNION ALL SELECT 1, query_id, doc_id, score, rank FROM ({_best_sql(20, source="c")}))"""


def _lists(spark: SparkSession, d: str) -> list[DataFrame]:
    wanted = fulltext.query_terms(_items(spark, d))
    some = fulltext.asked(wanted, "query_id", 20)
    index = fulltext.postings(table(spark, d, "documents"), vocabulary=fulltext.vocabulary_of(some))
    return [fulltext.top(index, wanted, 20, bm25=x, some=some).withColumnRenamed("doc_id", "unit_id") for x in (True, False)]


def _fused_sql(score: str, source: str = "l") -> str:
    return f"""WITH {LISTS_SQL}, z AS (SELECT query_id, doc_id AS unit_id, round({score}, 6) AS score FROM {source} GROUP BY query_id, doc_id)
      SELECT query_id, unit_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM z) WHERE rank <= 10"""


@query(_fused_sql("sum(1.0::DOUBLE / (60 + r))", "(SELECT *, row_number() OVER (PARTITION BY query_id, i ORDER BY score DESC, rank) - 1 AS r FROM l)"))
def fusion_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(_lists(spark, d), "reciprocal_rank")


@query(
    _fused_sql(
        "sum(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) WHEN hi > 0 THEN 1 ELSE 0 END * CASE i WHEN 0 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END)",
        "(SELECT *, min(score) OVER (PARTITION BY query_id, i) AS lo, max(score) OVER (PARTITION BY query_id, i) AS hi FROM l)",
    )
)
def fusion_relative(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(_lists(spark, d), "relative_score", weights=[3, 1])


@query(_fused_sql("max(score)"))
def fusion_simple(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(_lists(spark, d), "simple")


@query(f"WITH {_bm25_ctes('''regexp_replace(lower(text), '[^a-z]([a-z]{1,3})[^a-z]', ' ', 'g')''')} {_best_sql()}")
def query_rewrite(spark: SparkSession, d: str) -> DataFrame:
    q = fusion.rewrite(_items(spark, d), lambda c: F.regexp_replace(F.lower(c), "[^a-z]([a-z]{1,3})[^a-z]", " "))
    return fulltext.bm25(table(spark, d, "documents"), q).select("query_id", "doc_id", "score", "rank")


@query("SELECT doc_id FROM documents WHERE NOT coalesce(CASE WHEN n_chars > 4000 THEN 'lod' END = 'lod', false)")
def lod_exclusion(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return fusion.without_lod(docs, F.when(F.col("n_chars") > 4000, "lod")).select("doc_id")


@query()
def retrieve_fused(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.col("text").alias("content"), "lang")
    text = retrieve.FullTextRetriever(fulltext.FullTextIndex(units))
    vector = retrieve.VectorRetriever(collection.Collection.in_memory(embed(units)))
    queries = _items(spark, d)
    hits = retrieve.FusionRetriever([vector, text], "reciprocal_rank").retrieve(queries, 10)
    return retrieve.Reranker(head=["lang"]).rerank(hits, queries, units, 5)


# Post-processing


@query("SELECT o_orderpriority AS query_id, o_custkey AS unit_id, min(o_orderkey) AS pos FROM orders GROUP BY ALL")
def dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "orders").select(F.col("o_orderpriority").alias("query_id"), F.col("o_custkey").alias("unit_id"), F.col("o_orderkey").alias("pos"))
    return post.deduplicate(hits, F.col("unit_id"), [F.col("pos")])


@query("SELECT min(doc_id) AS doc_id, md5(text) AS hash FROM documents GROUP BY md5(text)")
def dedup_content(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("hash"))
    return post.deduplicate(docs, F.col("hash"), [F.col("doc_id")], within=())


@query("SELECT event_id, value / 100 AS score FROM events WHERE value / 100 >= 0.2")
def similarity_filter(spark: SparkSession, d: str) -> DataFrame:
    return post.similarity_filter(table(spark, d, "events").select("event_id", (F.col("value") / 100).alias("score")), 0.2)


def _budget_sql(order: str) -> str:
    return f"""SELECT query_id, pos, used_tokens FROM (SELECT conv_id AS query_id, turn AS pos, CAST(sum(CAST(floor(length(text) / 4.0) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used_tokens FROM conversations) WHERE used_tokens <= 300"""


def _chat_hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), F.col("text").alias("content"), (F.length("text") % 10).alias("score"))


@query(_budget_sql("length(text) % 10 DESC, turn"))
def token_budget_smart(spark: SparkSession, d: str) -> DataFrame:
    return post.token_budget(_chat_hits(spark, d), 300).select("query_id", "pos", "used_tokens")


@query(_budget_sql("turn"))
def token_budget_truncate(spark: SparkSession, d: str) -> DataFrame:
    return post.token_budget(_chat_hits(spark, d), 300, "truncate").select("query_id", "pos", "used_tokens")


def _window(spark: SparkSession, d: str, unique: bool) -> DataFrame:
    units = turns(spark, d)
    hits = units.where("role = 'user'").select(F.lit("q").alias("query_id"), F.col("seq").alias("pos"), "doc_id", "seq")
    return post.context_window(hits, units, 1, unique).select("pos", "shift", "doc_id", "seq")


WINDOW_SQL = """w AS (SELECT h.turn AS pos, CAST(c.turn - h.turn AS INTEGER) AS shift, c.conv_id AS doc_id, c.turn AS seq FROM conversations h JOIN conversations c ON c.conv_id = h.conv_id AND c.turn BETWEEN h.turn - 1 AND h.turn + 1 WHERE h.role = 'user')"""


@query(f"WITH {WINDOW_SQL} SELECT * FROM w")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    return _window(spark, d, False)


@query(f"WITH {WINDOW_SQL} SELECT pos, shift, doc_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, seq ORDER BY pos, shift) AS rn FROM w) WHERE rn = 1")
def context_window_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _window(spark, d, True)


@query("""WITH c AS (SELECT conv_id AS doc_id, turn AS seq, role = 'assistant' AS t, text, lag(text) OVER w AS before, lead(text) OVER w AS after, coalesce(lag(role = 'assistant') OVER w, false) OR coalesce(lead(role = 'assistant') OVER w, false) AS taken
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT doc_id, seq, CASE WHEN t THEN concat_ws(chr(10) || chr(10), before, text, after) ELSE text END AS content FROM c WHERE NOT taken""")
def table_context(spark: SparkSession, d: str) -> DataFrame:
    return post.table_context(turns(spark, d), F.col("role") == "assistant").select("doc_id", "seq", "content")


@query(f"""WITH {_bm25_ctes()}, top AS ({_best_sql(20)}),
  s AS (SELECT query_id, top.doc_id AS unit_id, round(len(list_intersect(list_distinct({TERMS.format("b.text")}), {TERMS.format("d.text")}))::DOUBLE / len(list_distinct({TERMS.format("b.text")})), 6) AS score
    FROM top JOIN documents d ON d.doc_id = top.doc_id JOIN benchmark b ON b.item_id = query_id)
  SELECT query_id, unit_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM s) WHERE rank <= 5""")
def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text")
    hits = _best(spark, d, 20).select("query_id", F.col("doc_id").alias("unit_id"))
    hits = hits.join(docs, "unit_id").join(_items(spark, d), "query_id")
    return post.rerank(hits, post.lexical_score(F.col("query"), F.col("text")), 5).select("query_id", "unit_id", "score", "rank")


@query("SELECT doc_id, substr('[' || concat_ws(' | ', lang, source) || ']' || chr(10) || text, 1, 2000) AS shown FROM documents")
def rerank_document_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", post.rerank_text([F.col("lang"), F.col("source")], F.col("text")).alias("shown"))


SENTENCES = "string_split(regexp_replace({}, '([.!?。])\\s+', '\\1' || chr(31), 'g'), chr(31))"


@query(f"""WITH {_bm25_ctes()}, top AS ({_best_sql(5)}),
  x AS (SELECT query_id, d.doc_id, d.text, {TERMS.format("b.text")} AS q, contains(lower(d.text), '<table') OR len(list_filter(string_split(d.text, chr(10)), lambda y: length(y) - length(replace(y, '|', '')) >= 2 AND contains(y, '-'))) > 0 AS tab
    FROM top JOIN documents d ON d.doc_id = top.doc_id JOIN benchmark b ON b.item_id = query_id),
  k AS (SELECT query_id, doc_id, tab, text, list_filter({SENTENCES.format("text")}, lambda y: list_has_any({TERMS.format("y")}, q)) AS kept FROM x)
  SELECT query_id, doc_id, CASE WHEN tab THEN text ELSE array_to_string(kept, chr(10) || chr(10)) END AS content FROM k WHERE tab OR len(kept) > 0""")
def select_excerpts(spark: SparkSession, d: str) -> DataFrame:
    hits = _best(spark, d, 5).join(table(spark, d, "documents"), "doc_id").join(_items(spark, d), "query_id")
    return post.select_excerpts(hits.withColumnRenamed("text", "content"), tx.looks_tabular(F.col("content"))).select("query_id", "doc_id", "content")


# Splitters


@query("""WITH c AS (SELECT conv_id AS doc_id, turn AS seq, substr(sha256(concat_ws(chr(31), conv_id, '', turn, text)), 1, 32) AS unit_id FROM conversations)
  SELECT doc_id, seq, unit_id, lag(unit_id) OVER w AS prev_unit_id, lead(unit_id) OVER w AS next_unit_id FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY seq)""")
def chain_links(spark: SparkSession, d: str) -> DataFrame:
    return split.chain(turns(spark, d)).select("doc_id", "seq", "unit_id", "prev_unit_id", "next_unit_id")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return split.as_units(table(spark, d, "documents"))


@query("""WITH s AS (SELECT doc_id, unnest(p) AS content, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?。])\\s+', '\\1' || chr(31), 'g'), chr(31)) AS p FROM documents))
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS seq, content FROM s WHERE trim(content) <> ''""")
def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    return split.split_sentences(_documents(spark, d)).select("doc_id", "seq", "content")


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM documents),
  i AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 512) / 462.0)) AS BIGINT) + 1)) AS i FROM w WHERE len(w) > 0)
  SELECT doc_id, CAST(i AS INTEGER) AS seq, array_to_string(list_slice(w, i * 462 + 1, i * 462 + 512), ' ') AS content FROM i""")
def chunk_tokens(spark: SparkSession, d: str) -> DataFrame:
    return split.chunk_tokens(_documents(spark, d)).select("doc_id", "seq", "content")


LINES_SQL = """ln AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM chats)),
  fe AS (SELECT *, sum(CASE WHEN starts_with(ltrim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS fences FROM ln)"""

HEADERS_SQL = f"""WITH {CHATS_SQL}, {LINES_SQL},
  hd AS (SELECT *, fences % 2 = 0 AND NOT starts_with(ltrim(line), '```') AND regexp_matches(line, '^(#+)[ \\t](.*)$') AS head FROM fe),
  sc AS (SELECT *, CASE WHEN head THEN length(regexp_extract(line, '^(#+)[ \\t](.*)$', 1)) END AS level, CASE WHEN head THEN trim(regexp_extract(line, '^(#+)[ \\t](.*)$', 2)) END AS title,
    sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sub FROM hd),
  st AS (SELECT doc_id, sub, max(level) AS level, max(title) AS title, regexp_replace(string_agg(CASE WHEN head THEN repeat('#', level) || ' ' || title ELSE line END, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS content FROM sc GROUP BY doc_id, sub),
  pa AS (SELECT s.doc_id, s.sub, string_agg(a.title, ' > ' ORDER BY a.sub) AS context_path FROM st s JOIN st a ON a.doc_id = s.doc_id AND a.level IS NOT NULL AND (a.sub = s.sub OR (a.sub < s.sub AND a.level < s.level
      AND NOT EXISTS (SELECT 1 FROM st b WHERE b.doc_id = a.doc_id AND b.sub > a.sub AND b.sub <= s.sub AND b.level <= a.level))) WHERE s.level IS NOT NULL GROUP BY s.doc_id, s.sub)
  SELECT st.doc_id, CAST(row_number() OVER (PARTITION BY st.doc_id ORDER BY st.sub) - 1 AS INTEGER) AS seq, content, context_path FROM st LEFT JOIN pa ON pa.doc_id = st.doc_id AND pa.sub = st.sub WHERE content <> ''"""


@query(HEADERS_SQL)
def split_headers(spark: SparkSession, d: str) -> DataFrame:
    return split.split_headers(split.as_units(chats_markdown(spark, d))).select("doc_id", "seq", "content", "context_path")


@query(f"SELECT doc_id, split_part(context_path, ' > ', 1) AS root, count(*) AS n FROM ({HEADERS_SQL}) GROUP BY doc_id, split_part(context_path, ' > ', 1)")
def header_paths(spark: SparkSession, d: str) -> DataFrame:
    units = split.split_headers(split.as_units(chats_markdown(spark, d)))
    return units.groupBy("doc_id", tx.path_root(F.col("context_path")).alias("root")).agg(F.count("*").alias("n"))


def _packed_sql(name: str, source: str, most: int, whole: bool = False) -> str:
    """CTEs up to ``name`` (doc_id, seq, content, context_path): texts of ``source`` packed by paragraphs, those over the limit by sentences; with ``whole`` a text within the limit stays as it is."""
    count = lambda c: f"len(list_filter(string_split_regex({c}, '\\s+'), lambda y: y <> ''))"
    keep = f"{count('content')} <= {most}" if whole else "false"
    edge = "regexp_replace(p, '^\\n+|\\n+$', '', 'g')" if whole else "p"
    deep = "regexp_replace(p, '^\\s+|\\s+$', '', 'g')" if whole else "p"
    return f"""{name}_p AS (SELECT doc_id, seq, context_path, i, p, {count("p")} AS n, {count("p")} > {most} AND NOT all_ AS big FROM (
    SELECT *, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT *, {keep} AS all_, CASE WHEN {keep} THEN [content] ELSE string_split(content, chr(10) || chr(10)) END AS ps FROM {source})) WHERE regexp_matches(p, '\\S')),
  {name}_s AS (SELECT *, 2 * (sum(CASE WHEN big THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, seq ORDER BY i) - CASE WHEN big THEN 1 ELSE 0 END) + CASE WHEN big THEN 1 ELSE 0 END AS seg FROM {name}_p),
  {name}_e AS (SELECT doc_id, seq, context_path, seg, i, 0 AS j, {edge} AS c FROM {name}_s WHERE NOT big
    UNION ALL SELECT doc_id, seq, context_path, seg, i, generate_subscripts(l, 1), unnest(l) FROM (SELECT *, {SENTENCES.format(deep)} AS l FROM {name}_s WHERE big)),
  {name}_o AS (SELECT *, {count("c")} AS n, row_number() OVER (PARTITION BY doc_id, seq, seg ORDER BY i, j) AS rn FROM {name}_e WHERE regexp_matches(c, '\\S')),
  {name}_g AS (SELECT doc_id, seq, seg, rn, n AS used, 0 AS grp FROM {name}_o WHERE rn = 1
    UNION ALL SELECT o.doc_id, o.seq, o.seg, o.rn, CASE WHEN g.used + o.n > {most} THEN o.n ELSE g.used + o.n END, CASE WHEN g.used + o.n > {most} THEN g.grp + 1 ELSE g.grp END
      FROM {name}_g g JOIN {name}_o o ON o.doc_id = g.doc_id AND o.seq = g.seq AND o.seg = g.seg AND o.rn = g.rn + 1),
  {name}_m AS (SELECT doc_id, seq, seg, grp, min(context_path) AS context_path, CASE WHEN seg % 2 = 1 THEN string_agg(c, ' ' ORDER BY rn) ELSE string_agg(c, chr(10) || chr(10) ORDER BY rn) END AS content FROM {name}_o JOIN {name}_g USING (doc_id, seq, seg, rn) GROUP BY doc_id, seq, seg, grp),
  {name} AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq, seg, grp) - 1 AS INTEGER) AS seq, content, context_path FROM {name}_m)"""


def _merged_sql(name: str, source: str, target: int) -> str:
    """CTEs up to ``name``: neighbours of ``source`` merged while their words are at most ``target``."""
    return f"""{name}_o AS (SELECT *, len(list_filter(string_split_regex(content, '\\s+'), lambda y: y <> '')) AS n FROM {source}),
  {name}_g AS (SELECT doc_id, seq, n AS used, 0 AS grp FROM {name}_o WHERE seq = 0
    UNION ALL SELECT o.doc_id, o.seq, CASE WHEN g.used + o.n > {target} THEN o.n ELSE g.used + o.n END, CASE WHEN g.used + o.n > {target} THEN g.grp + 1 ELSE g.grp END FROM {name}_g g JOIN {name}_o o ON o.doc_id = g.doc_id AND o.seq = g.seq + 1),
  {name} AS (SELECT doc_id, CAST(grp AS INTEGER) AS seq, string_agg(content, chr(10) || chr(10) ORDER BY seq) AS content, arg_min(context_path, seq) AS context_path FROM {name}_o JOIN {name}_g USING (doc_id, seq) GROUP BY doc_id, grp)"""


def _chained_sql(source: str, name: str = "") -> str:
    uid = f"substr(sha256(concat_ws(chr(31), CAST(doc_id AS VARCHAR), '{name}', CAST(seq AS VARCHAR), content)), 1, 32)"
    return f"""SELECT doc_id, seq, content, context_path, unit_id, lag(unit_id) OVER w AS prev_unit_id, lead(unit_id) OVER w AS next_unit_id FROM (SELECT *, {uid} AS unit_id FROM {source}) WINDOW w AS (PARTITION BY doc_id ORDER BY seq)"""


UNITS_SQL = f"{CHATS_SQL}, units AS (SELECT doc_id, 0 AS seq, text AS content, CAST(NULL AS VARCHAR) AS context_path FROM chats)"


@query(f"WITH RECURSIVE {UNITS_SQL}, {_packed_sql('t', 'units', 300, True)} {_chained_sql('t')}")
def split_text(spark: SparkSession, d: str) -> DataFrame:
    return split.chain(split.as_units(chats_markdown(spark, d)).transform(split.text_splitter(300)))


@query(f"WITH RECURSIVE {UNITS_SQL}, {_packed_sql('t', 'units', 200)} SELECT * FROM t")
def pack_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return split.as_units(chats_markdown(spark, d)).transform(split.paragraph_splitter(200))


PARTS_SQL = """SELECT p_brand AS doc_id, '| key | name | type |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || p_partkey || ' | ' || p_name || ' | ' || p_type || ' |', chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY p_brand"""

SPLIT_TABLE_SQL = f"""WITH RECURSIVE pt AS (PARTS), l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM pt),
  r AS (SELECT doc_id, l[1] || chr(10) || l[2] AS head, len(string_split(l[1], ' ')) + len(string_split(l[2], ' ')) AS base, unnest(l[3:]) AS r, generate_subscripts(l[3:], 1) AS i FROM l),
  o AS (SELECT *, len(string_split(r, ' ')) AS n FROM r),
  g AS (SELECT doc_id, i, base + n AS used, 0 AS grp FROM o WHERE i = 1
    UNION ALL SELECT o.doc_id, o.i, CASE WHEN g.used + o.n > 200 THEN o.base + o.n ELSE g.used + o.n END, CASE WHEN g.used + o.n > 200 THEN g.grp + 1 ELSE g.grp END FROM g JOIN o ON o.doc_id = g.doc_id AND o.i = g.i + 1)
  SELECT doc_id, CAST(grp AS INTEGER) AS seq, min(head) || chr(10) || string_agg(r, chr(10) ORDER BY i) AS content, CAST(NULL AS VARCHAR) AS context_path FROM o JOIN g USING (doc_id, i) GROUP BY doc_id, grp"""


@query(SPLIT_TABLE_SQL.replace("PARTS", PARTS_SQL))
def split_table(spark: SparkSession, d: str) -> DataFrame:
    parts = _part_tables(spark, d)
    return split.as_units(parts).transform(split.table_splitter(200))


@query(f"WITH RECURSIVE h AS ({HEADERS_SQL}), {_merged_sql('m', 'h', 300)} SELECT * FROM m")
def merge_greedy(spark: SparkSession, d: str) -> DataFrame:
    return split.merge_small(split.split_headers(split.as_units(chats_markdown(spark, d))), 300)


@query(f"""WITH RECURSIVE h AS ({HEADERS_SQL}), {_packed_sql('t', 'h', 200, True)}, s AS (SELECT doc_id, seq, content, context_path FROM t), {_merged_sql('m', 's', 400)} {_chained_sql('m', 'pipeline')}""")
def split_pipeline(spark: SparkSession, d: str) -> DataFrame:
    units = split.as_units(chats_markdown(spark, d)).transform(split.split_headers).transform(split.text_splitter(200)).transform(split.table_splitter(200))
    return split.chain(split.merge_small(units, 400), "pipeline")


# Tables


PART_HEAD = ("key", "name", "type")


def _part_rows(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, columns, rows): for each brand a table of its parts."""
    row = F.array(F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_type"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda x: x["r"])
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("doc_id")).agg(F.array(*map(F.lit, PART_HEAD)).alias("columns"), rows.alias("rows"))


def _part_tables(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): the same as pipe tables."""
    return _part_rows(spark, d).select("doc_id", tables.to_markdown(F.col("columns"), F.col("rows")).alias("text"))


def _part_texts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): the same between two sentences."""
    return _part_tables(spark, d).select("doc_id", F.concat(F.lit("Parts follow.\n\n"), "text", F.lit("\n\nThat is all.")).alias("text"))


@query(PARTS_SQL)
def table_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _part_tables(spark, d)


PARTS_HTML_SQL = """SELECT p_brand AS doc_id, '<table><thead><tr><th>key</th><th>name</th><th>type</th></tr></thead><tbody>' || string_agg('<tr><td>' || p_partkey || '</td><td>' || p_name || '</td><td>' || p_type || '</td></tr>', '' ORDER BY p_partkey) || '</tbody></table>' AS html FROM part GROUP BY p_brand"""


@query(PARTS_HTML_SQL)
def table_md_to_html(spark: SparkSession, d: str) -> DataFrame:
    return _part_tables(spark, d).select("doc_id", tables.pipe_to_html(F.col("text")).alias("html"))


@query("SELECT p_brand AS doc_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS row_no, CAST(p_partkey AS VARCHAR) AS key, p_name AS name FROM part")
def table_parse_md(spark: SparkSession, d: str) -> DataFrame:
    t = _part_texts(spark, d).select("doc_id", F.explode(tables.pipe_tables(F.col("text"))).alias("t")).select("doc_id", tables.parse_pipe(F.col("t")).alias("p"))
    return t.select("doc_id", F.posexplode("p.rows").alias("row_no", "r")).select("doc_id", "row_no", F.col("r")[0].alias("key"), F.col("r")[1].alias("name"))


@query("SELECT p_brand AS doc_id, 'markdown' AS source_format, count(*) AS n_rows FROM part GROUP BY p_brand")
def table_units(spark: SparkSession, d: str) -> DataFrame:
    t = tables.table_units(split.as_units(_part_texts(spark, d)))
    return t.select("doc_id", F.col("table.source_format").alias("source_format"), F.size("table.rows").cast("bigint").alias("n_rows"))


@query("SELECT p_partkey, array_to_string(list_slice(list_concat(string_split(p_name || ' ' || p_type, ' '), ['', '', '', '']), 1, 4), '|') AS cells FROM part")
def table_row_repair(spark: SparkSession, d: str) -> DataFrame:
    row = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    return table(spark, d, "part").select("p_partkey", F.array_join(tables.repair_row(row, F.lit(4)), "|").alias("cells"))


@query("""SELECT c_nationkey AS doc_id, coalesce(bool_or(c_mktsegment = 'BUILDING'), false) AS hard FROM customer GROUP BY c_nationkey""")
def table_complexity(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    row = F.array(F.col("c_name"), F.col("c_mktsegment"), F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment")).otherwise("-"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("r")))), lambda x: x["r"])
    text = tables.to_markdown(F.array(F.lit("a"), F.lit("b"), F.lit("c")), rows)
    return c.groupBy(F.col("c_nationkey").alias("doc_id")).agg(text.alias("t")).select("doc_id", tables.is_complex(F.col("t")).alias("hard"))


@query("""SELECT p_brand AS doc_id, string_agg('key: ' || p_partkey || ', name: ' || p_name || ', type: ' || p_type, '; ' ORDER BY p_partkey) AS summary, 'Table with columns: key, name, type' AS caption, true AS critical FROM part GROUP BY p_brand""")
def table_enrichment(spark: SparkSession, d: str) -> DataFrame:
    t = _part_texts(spark, d).select("doc_id", F.explode(tables.pipe_tables(F.col("text"))).alias("t")).select("doc_id", tables.parse_pipe(F.col("t")).alias("p")).select("doc_id", "p.*")
    c, r = F.col("columns"), F.col("rows")
    return t.select("doc_id", enrich.summarise_table(c, r).alias("summary"), enrich.caption_table(c).alias("caption"), enrich.is_data_critical(c, r).alias("critical"))


@query(PARTS_HTML_SQL)
def table_page_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each table cut into two pages, the head on both, and put together again."""
    merged = tx.by_value(lambda p: tables.merge_pages([x for x in p if x]))
    half = F.ceil(F.size("rows") / 2).cast("int")
    page = lambda rows: tables.pipe_to_html(tables.to_markdown(F.col("columns"), rows))
    two = F.array(page(F.slice("rows", F.lit(1), half)), F.when(F.size("rows") > 1, page(F.slice("rows", half + 1, F.size("rows") - half))).otherwise(""))
    return _part_rows(spark, d).select("doc_id", merged(two).alias("html"))


# Documents and pages


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), F.col("text").alias("content"))


SPANS_SQL = """sp AS (SELECT conv_id AS doc_id, turn AS page_number, length(text) AS n, CAST(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn) - 2 AS BIGINT) AS span_end FROM conversations)"""


@query("SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content, count(*) AS n_pages FROM conversations GROUP BY conv_id")
def doc_merge(spark: SparkSession, d: str) -> DataFrame:
    return documents.merge(_pages(spark, d)).select("doc_id", "content", F.size("pages").cast("bigint").alias("n_pages"))


@query(f"WITH {SPANS_SQL} SELECT doc_id, page_number, span_end - n AS span_start, span_end FROM sp")
def doc_pages_spans(spark: SparkSession, d: str) -> DataFrame:
    return documents.page_spans(_pages(spark, d)).select("doc_id", "page_number", "span_start", "span_end")


@query(f"""WITH {SPANS_SQL}, l AS (SELECT doc_id, max(span_end) AS n FROM sp GROUP BY doc_id)
  SELECT l.doc_id, string_agg(page_number, ',' ORDER BY page_number) AS pages FROM l JOIN sp ON sp.doc_id = l.doc_id AND span_end - sp.n < l.n // 2 AND span_end > l.n // 4 GROUP BY l.doc_id""")
def page_overlap(spark: SparkSession, d: str) -> DataFrame:
    docs = documents.merge(_pages(spark, d)).withColumn("n", F.length("content"))
    return docs.select("doc_id", F.array_join(documents.pages_of_span(F.col("pages"), F.expr("n div 4"), F.expr("n div 2")), ",").alias("pages"))


@query("""SELECT conv_id AS doc_id, CASE WHEN count(*) = 1 THEN 'p' || min(turn) WHEN max(turn) - min(turn) + 1 = count(*) THEN 'p' || min(turn) || '-' || max(turn) ELSE 'p' || string_agg(turn, ',' ORDER BY turn) END AS label
  FROM conversations WHERE role = 'user' OR turn = 0 GROUP BY conv_id""")
def page_labels(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).join(turns(spark, d).select("doc_id", F.col("seq").alias("page_number"), "role"), ["doc_id", "page_number"]).where("role = 'user' OR page_number = 0")
    return p.groupBy("doc_id").agg(F.collect_list("page_number").alias("p")).select("doc_id", tx.page_label(F.col("p")).alias("label"))


@query()
def page_infer(spark: SparkSession, d: str) -> DataFrame:
    docs = documents.merge(_pages(spark, d))
    units = split.as_units(docs, "doc_id", "content").transform(split.paragraph_splitter(120))
    none = F.lit(None).cast("int")
    return pages.infer_page_numbers(units.withColumns({"start": none, "end": none}), docs)


@query()
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", readers.html_text("html").alias("text"))


@query("SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1)) AS extension, regexp_matches(url, '(?i)^https?://[^/ ]+') AS is_url FROM pages")
def source_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", readers.extension(F.col("url")).alias("extension"), readers.is_url(F.col("url")).alias("is_url"))


# Trees

NODES_SQL = f"""{CHATS_SQL}, {LINES_SQL},
  hd AS (SELECT *, fences % 2 = 0 AND NOT starts_with(trim(line), '```') AND regexp_matches(trim(line), '^(#{{1,6}})[ \\t]+(.+)$') AS head FROM fe),
  sc AS (SELECT *, CASE WHEN head THEN length(regexp_extract(trim(line), '^(#{{1,6}})[ \\t]+(.+)$', 1)) END AS level, CASE WHEN head THEN trim(regexp_extract(trim(line), '^(#{{1,6}})[ \\t]+(.+)$', 2)) END AS title,
    sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS ord FROM hd),
  nd AS (SELECT doc_id, CAST(ord AS INTEGER) AS ord, CAST(max(level) AS INTEGER) AS level, max(title) AS title, CAST(min(i) AS INTEGER) AS line_start, CAST(max(i) AS INTEGER) AS line_end FROM sc WHERE ord > 0 GROUP BY doc_id, ord),
  nodes AS (SELECT n.doc_id, lpad(CAST(n.ord AS VARCHAR), 4, '0') AS node_id, lpad(CAST(max(p.ord) AS VARCHAR), 4, '0') AS parent_id, n.ord, n.level, n.title, n.line_start, n.line_end
    FROM nd n LEFT JOIN nd p ON p.doc_id = n.doc_id AND p.ord < n.ord AND p.level < n.level GROUP BY ALL)"""


@query(f"WITH {NODES_SQL} SELECT * FROM nodes")
def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    return trees.tree_nodes(chats_markdown(spark, d)).select("doc_id", "node_id", "parent_id", "ord", "level", "title", "line_start", "line_end")


@query(f"WITH {NODES_SQL} SELECT doc_id, string_agg(repeat('  ', level - 1) || '[' || node_id || '] ' || title, chr(10) ORDER BY ord) AS outline FROM nodes GROUP BY doc_id")
def tree_outline(spark: SparkSession, d: str) -> DataFrame:
    return trees.outline(trees.tree_nodes(chats_markdown(spark, d)))


@query(f"""WITH RECURSIVE {NODES_SQL}, r AS (SELECT doc_id, node_id, level FROM nodes WHERE parent_id IS NULL AND level <= 2
    UNION ALL SELECT n.doc_id, n.node_id, n.level FROM nodes n JOIN r ON n.doc_id = r.doc_id AND n.parent_id = r.node_id WHERE n.level <= 2) SELECT doc_id, node_id FROM r""")
def tree_descend(spark: SparkSession, d: str) -> DataFrame:
    return trees.descend(trees.tree_nodes(chats_markdown(spark, d)), F.col("level") <= 2).select("doc_id", "node_id")


@query()
def tree_summaries(spark: SparkSession, d: str) -> DataFrame:
    return trees.summaries(trees.tree_nodes(chats_markdown(spark, d))).select("doc_id", "node_id", "summary")


@query()
def tree_mcts(spark: SparkSession, d: str) -> DataFrame:
    nodes = trees.tree_nodes(chats_markdown(spark, d)).withColumn("query_id", F.lit(0))
    return trees.search_tree(nodes, trees.lexical_relevance(F.lit("the and of user"), F.col("text")))


# Graphs and relations


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = lambda c: F.col(c).cast("string")
    node = lambda t, label, key: table(spark, d, t).select(F.lit(label).alias("label"), s(key).alias("id"))
    nodes = node("region", "region", "r_regionkey").union(node("nation", "nation", "n_nationkey")).union(node("customer", "customer", "c_custkey")).union(node("supplier", "supplier", "s_suppkey"))
    edge = lambda t, label, key, to, ref, rel: table(spark, d, t).select(F.lit(label).alias("src_label"), s(key).alias("src"), F.lit(to).alias("dst_label"), s(ref).alias("dst"), F.lit(rel).alias("rel_type"))
    edges = edge("nation", "nation", "n_nationkey", "region", "n_regionkey", "IN").union(edge("customer", "customer", "c_custkey", "nation", "c_nationkey", "OF")).union(edge("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "OF"))
    return nodes, edges


EDGES_SQL = """e AS (SELECT 'nation' AS src_label, CAST(n_nationkey AS VARCHAR) AS src, 'region' AS dst_label, CAST(n_regionkey AS VARCHAR) AS dst, 'IN' AS rel_type FROM nation
  UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'nation', CAST(c_nationkey AS VARCHAR), 'OF' FROM customer UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 'nation', CAST(s_nationkey AS VARCHAR), 'OF' FROM supplier)"""


@query("SELECT 'nation' AS label, CAST(n_nationkey AS VARCHAR) AS id, 'key=' || n_nationkey || ',name=' || lower(n_name) || ',region=' || n_regionkey AS props FROM nation")
def graph_merge_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    first = F.create_map(F.lit("key"), F.col("n_nationkey").cast("string"), F.lit("name"), F.col("n_name"))
    second = F.create_map(F.lit("name"), F.lower("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    rows = [n.select(F.lit("nation").alias("label"), F.col("n_nationkey").cast("string").alias("id"), p.alias("props"), F.lit(k).alias("batch")) for k, p in enumerate((first, second))]
    merged = graph.merge_nodes(rows[0].union(rows[1]))
    return merged.select("label", "id", F.array_join(F.array_sort(F.transform(F.map_entries("props"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ",").alias("props"))


@query(f"WITH {EDGES_SQL} SELECT src_label AS label, src AS id, rel_type, dst_label AS other_label, dst AS other FROM e UNION ALL SELECT dst_label, dst, rel_type, src_label, src FROM e")
def graph_relationships_both(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.relationships(graph.create_edges(edges, nodes), "both")


@query(f"WITH {EDGES_SQL} SELECT * FROM e WHERE NOT (src_label = 'nation' AND src IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 0)) AND NOT (dst_label = 'nation' AND dst IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 0))")
def graph_detach_delete(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    gone = table(spark, d, "nation").where("n_regionkey = 0").select(F.lit("nation").alias("label"), F.col("n_nationkey").cast("string").alias("id"))
    return graph.detach_delete(nodes, edges, gone)[1]


@query("SELECT 'region' AS label, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier")
def graph_node_count(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_count(_graph(spark, d)[0])


@query("""SELECT CAST(k AS VARCHAR) AS n0, CAST(n_nationkey AS VARCHAR) AS n1, CAST(n_regionkey AS VARCHAR) AS n2 FROM (SELECT c_custkey AS k, c_nationkey AS n FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier) JOIN nation ON n = n_nationkey""")
def graph_match_path(spark: SparkSession, d: str) -> DataFrame:
    return graph.match_path(_graph(spark, d)[1], "OF", "IN")


@query("""SELECT 'n' || n_nationkey AS src, 'parent' AS rel, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'r' || n_regionkey, 'children', 'n' || n_nationkey FROM nation""")
def relations_bidirectional(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.lit("parent").alias("rel"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    return graph.both_ways(n)


# Enrichment


@query(f"""WITH p AS (SELECT doc_id, unnest({TERMS.format("text")}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  r AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * ln((SELECT count(*) FROM documents) / df), 6) DESC, term) AS rn FROM tf JOIN df USING (term))
  SELECT doc_id, string_agg(term, ' ' ORDER BY rn) AS keywords FROM r WHERE rn <= 5 GROUP BY doc_id""")
def keywords_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return enrich.keywords(table(spark, d, "documents")).select("doc_id", F.array_join("keywords", " ").alias("keywords"))


HEADINGS_SQL = """WITH s AS (SELECT p_brand AS doc_id, p_partkey AS span_no, trim(p_name) AS text, CAST(p_size AS DOUBLE) AS size, p_size % 7 = 0 AS bold FROM part),
  b AS (SELECT doc_id, size AS body FROM (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, size) AS rn FROM s GROUP BY doc_id, size) WHERE rn = 1),
  r AS (SELECT s.*, round(size / body, 2) AS ratio, upper(text) = text AND lower(text) <> text AS caps FROM s JOIN b USING (doc_id)),
  l AS (SELECT *, CASE WHEN ratio >= 1.5 THEN 1 WHEN ratio >= 1.3 THEN 2 WHEN ratio >= 1.15 THEN 3 WHEN ratio >= 1.05 THEN 4 ELSE 5 END AS lv FROM r)
  SELECT doc_id, 1 AS page, span_no, text, CAST(greatest(1, CASE WHEN caps THEN lv - 1 ELSE lv END) AS INTEGER) AS level FROM l WHERE len(string_split_regex(text, '\\s+')) <= 15 AND length(text) BETWEEN 2 AND 200 AND (bold OR caps OR ratio > 1.1)"""


@query(HEADINGS_SQL)
def headings_from_layout(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("doc_id"), F.lit(1).alias("page"), F.col("p_partkey").alias("span_no"), F.col("p_name").alias("text"), F.col("p_size").cast("double").alias("size"), (F.col("p_size") % 7 == 0).alias("bold"))
    return enrich.headings(p)


@query(f"""WITH {_bm25_ctes()}, top AS ({_best_sql(3)}),
  c AS (SELECT b.item_id AS query_id, any_value({TERMS.format("b.text")}) AS q, list(d.doc_id ORDER BY rank) FILTER (WHERE d.doc_id IS NOT NULL) AS ids,
    coalesce(string_agg('[' || d.doc_id || ']:' || chr(10) || d.text, chr(10) || chr(10) ORDER BY rank), '') AS context
    FROM benchmark b LEFT JOIN top ON query_id = item_id LEFT JOIN documents d ON d.doc_id = top.doc_id GROUP BY b.item_id),
  s AS (SELECT query_id, q, unnest({SENTENCES.format("context")}) AS t, generate_subscripts({SENTENCES.format("context")}, 1) AS i FROM c),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, i) AS rn FROM (SELECT query_id, t, i, len(list_intersect(list_distinct(q), {TERMS.format("t")})) AS n FROM s))
  SELECT query_id, coalesce(ids, []) AS citations, CASE WHEN trim(context) = '' THEN 'There is nothing to answer from.' ELSE coalesce((SELECT string_agg(t, ' ' ORDER BY rn) FROM k WHERE k.query_id = c.query_id AND rn <= 3 AND n > 0), '') END AS answer FROM c""")
def answer_extractive(spark: SparkSession, d: str) -> DataFrame:
    hits = _best(spark, d, 3).join(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")
    asked = enrich.prompts(_items(spark, d), hits.select("query_id", F.col("doc_id").alias("unit_id"), F.col("rank").alias("pos"), "content"))
    return asked.select("query_id", "citations", enrich.extractive_answer(F.col("query"), F.col("context")).alias("answer"))


@query()
def compress_documents(spark: SparkSession, d: str) -> DataFrame:
    return enrich.compress_units(_documents(spark, d), 100).select("doc_id", "content")


@query()
def embed_documents(spark: SparkSession, d: str) -> DataFrame:
    return embed(_documents(spark, d).select("doc_id", "content")).select("doc_id", "embedding")


# Scalars


@query("SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE value END AS value FROM events")
def metadata_json_safe(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("v", F.when(F.col("user_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return e.select("event_id", tx.finite(F.col("v")).alias("value"))


@query("SELECT doc_id, lang AS low, md5(text) AS full_hash FROM documents")
def view_by_level(spark: SparkSession, d: str) -> DataFrame:
    view = lambda level, c: F.struct(F.lit(level).alias("level"), c.alias("content"))
    views = table(spark, d, "documents").select("doc_id", F.array(view("full", F.col("text")), view("low", F.col("lang"))).alias("views"))
    return views.select("doc_id", documents.best_view(F.col("views"), "low")["content"].alias("low"), F.md5(documents.views_in_order(F.col("views"))[1]["content"]).alias("full_hash"))


@query("SELECT doc_id, md5(text) AS hash, CAST(floor(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("hash"), tx.token_estimate(F.col("text")).alias("tokens"))


@query()
def normalized_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.xxh64_hex(tx.normalize_text("text")).alias("hash"))


# Incremental ingest


@query("SELECT event_id, event_type, value FROM events")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    target = collection.Collection.local(spark, scratch(spark, "events"), "event_id")
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(file).isDirectory()
    landing, names = (path, None) if folder else (d, "events.parquet")
    keep = lambda b: b.select("event_id", "event_type", "value")
    stream_upsert(spark, landing, spark.read.parquet(path).schema, target, scratch(spark, "stream"), keep, names=names).awaitTermination()
    return target.rows
