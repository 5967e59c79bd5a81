"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from docloom.operators import fulltext, search, split
from docloom.plans import queries as plans
from docloom.session import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
HEADLINE = ("vector_topk", "fulltext_bm25", "fusion_rrf", "dedup_content", "filter_json_path", "filter_range", "context_window_dedup", "split_sentences", "chunk_tokens", "split_pipeline", "keywords_tfidf", "token_budget_smart")


def main() -> None:
    spark = session("bench", spark__master=f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="16g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")

    def vector_topk_single():
        e = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
        return search.topk(e, e.orderBy("vec_id").first()["embedding"]).select("vec_id", "score")

    def vector_topk_50():
        e = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
        return search.knn(e.orderBy("vec_id").limit(50).withColumnRenamed("vec_id", "query_id"), e)

    def two_terms():
        """50 queries of two terms each: the first and the last long word of a benchmark text."""
        b = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").limit(50)
        w = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: F.length(x) >= 4)
        return b.select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.get(w, F.lit(0)), F.get(w, F.size(w) - 1)).alias("query"))

    kept: list = []

    def bm25_two_terms():
        """Search of an index whose postings the warm-up has made."""
        if not kept:
            kept.append(fulltext.FullTextIndex(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "doc_id", "text"))
        return kept[0].search(two_terms())

    def chunk_documents():
        """Headings, text, tables, merging, over documents."""
        units = split.as_units(spark.read.parquet(f"{SF_DIR}/documents.parquet")).transform(split.split_headers).transform(split.text_splitter(1200)).transform(split.table_splitter(1500))
        return split.merge_small(units, 500)

    more = {f.__name__: f for f in (vector_topk_single, vector_topk_50, bm25_two_terms, chunk_documents)}
    runs = {name: (lambda q=plans.QUERIES[name]: q(spark, SF_DIR)) for name in HEADLINE} | more
    took = {}
    for name, make in runs.items():
        times = []
        for k in range(RUNS + 1):  # the first warms up
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 3)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    rates = {"chunk_docs_per_s": round(docs["n"] / took["chunk_documents"]), "chunk_mb_per_s": round(docs["b"] / 1e6 / took["chunk_documents"], 1)}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": int(CPUS), **rates}))
    spark.stop()


if __name__ == "__main__":
    main()
