import numpy as np
import pyarrow as pa
import pytest
from cases import none, odd
from pyspark.sql import functions as F

from docloom.llm import knn, langid, textvec


@pytest.fixture(scope="module")
def tables(spark, data):
    big = data.replace("sf0.001", "sf0.01")
    return spark.read.parquet(f"{big}/documents.parquet").cache(), spark.read.parquet(f"{big}/labels.parquet").cache()


def test_quality_on_held_out_documents(tables):
    docs, labels = tables
    half = labels.where("doc_id % 2 = 0")
    texts, good = knn.labelled_sample(docs, half)
    scores = knn.score(docs.select("doc_id", "text"), knn.train(texts, good)).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    clean = [r.quality_score >= knn.LEAST for r in scores if r.quality and r.text]
    junk = [r.quality_score < knn.LEAST for r in scores if not r.quality]
    assert np.mean(clean) > 0.98 and np.mean(junk) > 0.85


def test_votes_are_brute_force():
    """Every document's cosines with all labelled ones, one by one, ties by their order; repeated texts make many ties."""
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["aa", "bb", "CC!!", "dd&&"], 20)) for _ in range(60)] + ["aa bb"] * 12
    m = knn.train(texts, (rng.random(72) > 0.5).astype(int).tolist(), dim=8, neighbours=5)
    asked = [*texts[:10], "aa bb", "bb aa bb"]
    got = m.scores(pa.array(asked))
    v = m.project(knn.terms(pa.array(asked)))
    for i in range(len(asked)):
        cos = [round(float(c), knn.DIGITS) for c in np.round(v[i : i + 1] @ m.vectors.T, knn.DIGITS)[0]]
        near = sorted(range(72), key=lambda j: (-cos[j], j))[:5]
        w = [max(cos[j], 0) ** knn.SHARPNESS for j in near]
        assert abs(got[i] - sum(a * m.good[j] for a, j in zip(w, near, strict=True)) / sum(w)) < 2 * 10**-knn.DIGITS


def test_repeated_rows_stay_on_the_executors(spark):
    docs = spark.range(3000).selectExpr("id % 3 AS doc_id", "concat('text ', id % 2) AS text", "'en' AS lang")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id bigint, quality int")
    assert knn.labelled_sample(docs, labels) == (["text 0", "text 0"], [1, 0])
    assert len(langid.training_sample(docs)[0]) == 6  # ids and texts


def test_long_texts_are_counted_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    rows = pa.array(["", "kurz", "".join(rng.choice(list("abc dE.,7é"), 5000)), "".join(rng.choice(list("xyz Q!"), 800))])
    whole = knn.terms(rows), langid.features(rows)[0]
    monkeypatch.setattr(textvec, "BLOCK_BYTES", 100)
    assert (knn.terms(rows) == whole[0]).all() and (langid.features(rows)[0] == whole[1]).all()


def brute_language(text, model):
    """One text's language by plain loops over its folded bytes."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    raw = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in raw)
    counts = np.zeros(langid.BUCKETS)
    for size in (3, 4):
        for i in range(len(raw) - size + 1):
            g = raw[i : i + size]
            if g[:2] == b"  " or g[-2:] == b"  ":
                continue
            code = ((g[0] << 24 | g[1] << 16 | g[2] << 8 | (g[3] if size == 4 else 0)) + size) & 0xFFFFFFFF
            mixed = code * 2654435761 & 0xFFFFFFFF
            counts[(((mixed ^ mixed >> 15) * 2246822519 & 0xFFFFFFFF) >> 16) % langid.BUCKETS] += 1
    z = (counts / (counts.sum() + langid.NEUTRAL) @ model.table + model.bias) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return (model.languages[int(p.argmax())] if p.max() >= model.least and counts.sum() else langid.NONE), p.max(), int(counts.sum())


def test_languages_are_brute_force(tables, spark):
    docs, _ = tables
    model = langid.train(*langid.training_sample(docs, 100))
    some = docs.orderBy("n_chars").limit(120)
    got = {r.doc_id: r for r in langid.identify(some, model).collect()}
    for r in some.collect():
        name, sure, n = brute_language(r.text or "", model)
        assert got[r.doc_id].n_grams == n and abs(got[r.doc_id].confidence - sure) < 1e-4
        assert got[r.doc_id].lang_id == name or abs(sure - model.least) < 1e-4


def test_quality_cases(spark):
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (4, 0, 0), (9, 0, 0), (None, 1, 0), (5, None, 0), (77, 1, 0)], "doc_id bigint, quality int, toxic int")
    kept = knn.filter_quality(odd(spark), labels)
    assert kept.columns == odd(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert {0, 1} <= set(ids) and ids.count(4) in (0, 3)
    assert knn.filter_quality(odd(spark), labels.limit(0)).count() == odd(spark).count()
    assert knn.filter_quality(none(spark), labels).count() == 0
    assert knn.kept_scores(none(spark), labels).count() == 0


def test_languages_on_held_out_documents(tables):
    docs, _ = tables
    texts, langs = langid.training_sample(docs.where("doc_id % 2 = 0"), 200)
    model = langid.train(texts, langs)
    got = langid.identify(docs.where("doc_id % 2 = 1 AND n_chars > 100"), model).join(docs, "doc_id").collect()
    said = [r for r in got if r.lang_id != langid.NONE]
    assert len(said) / len(got) > 0.95 and np.mean([r.lang_id == r.lang for r in said]) > 0.97


def test_rejection_is_calibrated(tables):
    docs, _ = tables
    model = langid.train(*langid.training_sample(docs, 200))
    noise = pa.array(["", "12345 !!! ???", "zq", "xkcd qwzx vvvv jjjj"])
    p = model.probabilities(langid.features(noise)[0]).max(axis=1)
    assert (p[:3] < model.least).all()
    assert 0.25 <= model.temperature <= 8 and 0 < model.least < 1


def test_language_cases(spark):
    got = langid.identify_languages(odd(spark)).collect()
    assert len(got) == odd(spark).count()
    assert all(r.lang_id == langid.NONE for r in got if r.doc_id in (0, 1, 2, 8))
    assert langid.identify_languages(none(spark)).count() == 0
    unlabelled = langid.identify_languages(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_id for r in unlabelled} == {langid.NONE}
