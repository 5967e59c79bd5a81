import numpy as np

from docloom.operators import search


def test_knn_is_brute_force_over_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 8)).astype(np.float32)
    x[7] = x[3]  # a tie
    x[11] = 0
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = search.knn(df.withColumnRenamed("vec_id", "query_id"), df, 5).collect()
    n = np.linalg.norm(x.astype(float), axis=1)
    s = np.round(x.astype(float) @ x.astype(float).T / np.maximum(n[:, None] * n[None, :], 1e-300), 6)
    want = {(q, int(v), r + 1) for q in range(90) for r, v in enumerate(sorted(range(90), key=lambda i: (-s[q, i], i))[:5])}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == want


def test_topk_is_one_sort(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    q = e.where("vec_id = 0").first().embedding
    top = search.topk(e, q, 3)
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()
    assert top.first().vec_id == 0


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert search.knn(none.withColumnRenamed("vec_id", "query_id"), none).count() == 0
