import hashlib
import math
import re

import corpus_pipeline
import pyarrow as pa
from cases import SCHEMA, odd

from docloom.llm import jaccard, knn, mixing, packing, secrets


def test_stages_by_the_operators_one_by_one(spark, data):
    """Each stage's rows against plain Python over the stage's own input."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = dict(corpus_pipeline.STAGES)

    def rows(df):
        assert df.columns == columns
        return sorted((tuple(r) for r in df.collect()), key=repr)

    kept = stage["quality classifier"](spark, docs, data)
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = knn.train(*knn.labelled_sample(docs, labels))
    want = [r for r in docs.collect() if model.scores(pa.array([r.text]))[0] >= knn.LEAST]
    assert rows(kept) == sorted((tuple(r) for r in want), key=repr)

    one = stage["near duplicates"](spark, kept, data)
    groups = jaccard.brute_force([r.text for r in want])[0]
    first = {}
    for r, g in zip(want, groups, strict=True):
        if g is not None:
            first[g] = min(first.get(g, r.doc_id), r.doc_id)
    want = [r for r, g in zip(want, groups, strict=True) if g is None or first[g] == r.doc_id]
    assert rows(one) == sorted((tuple(r) for r in want), key=repr)

    clean = stage["secret scan"](spark, one, data)
    planted = re.compile(r"((?:token|password)\s*=\s*\"?)([0-9a-f]{18,40})\b", re.I)
    hidden = [r.asDict() | {"text": planted.sub(r"\1" + secrets.MASK, r.text)} for r in want]
    hidden = [r | {"n_chars": len(r["text"]) if secrets.MASK in r["text"] else r["n_chars"]} for r in hidden]
    assert rows(clean) == sorted((tuple(r[c] for c in columns) for r in hidden), key=repr)

    mixed = stage["mix sources"](spark, clean, data)
    drawn = []
    words = lambda r: len([w for w in re.split(r"[ \t\n\r]+", r["text"]) if w])
    sources = {r["source"]: [] for r in hidden}
    for r in hidden:
        weight = max(0.05, 1 - len(re.sub("[a-zß-öø-ÿ ]+", "", r["text"])) / max(1, len(r["text"])))
        u = (int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}:{r['text']}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        sources[r["source"]].append((-math.log(u) / weight, r["doc_id"], words(r), r))
    share = {s: mixing.TARGETS.get(s, mixing.OTHER) for s in sources}
    for s, members in sources.items():
        tokens = sum(m[2] for m in members)
        budget = math.floor(sum(map(words, hidden)) * share[s] / sum(share.values()))
        rest = budget - budget // tokens * tokens
        for m in sorted(members, key=lambda m: m[:2]):
            rest -= m[2]
            drawn += [m[3]] * (budget // tokens + (rest >= 0))
    assert rows(mixed) == sorted((tuple(r[c] for c in columns) for r in drawn), key=repr)

    packs = stage["pack"](spark, mixed, data).collect()
    pieces = sorted((p.doc_id, p.start, p.length) for r in packs for p in r.pieces)
    assert pieces == sorted((r["doc_id"], a, min(packing.WINDOW, words(r) - a)) for r in drawn for a in range(0, words(r), packing.WINDOW))
    assert all(r.n_tokens <= packing.WINDOW for r in packs)


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_rows_pass_every_stage(spark, tmp_path):
    odd(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
