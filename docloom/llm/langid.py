"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workers import map_arrow
from . import textvec

BUCKETS = 4096
DIM = 16
#: Bounds of the training sample: documents of one language, and of all.
PER_LANGUAGE = 600
SAMPLE = 6000
#: Languages that are learned, the most frequent ones; fewer documents than this of one say nothing.
LANGUAGES = 200
#: Neutral n-grams added to every average, so that little text gives little confidence.
NEUTRAL = 20.0
EPOCHS = 12
RATE = 1.0
PRECISION = 0.99
NONE = "und"


def _fold() -> np.ndarray:
    b = np.arange(256)
    low = np.where((b >= 65) & (b <= 90), b + 32, b)
    return np.where((b >= 128) | ((low >= 97) & (low <= 122)), low, 32).astype(np.uint32)


FOLD = _fold()


def subwords(raw: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, start: int = 0, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of the byte trigrams and tetragrams of the folded text: letters stay, all else is a blank; runs of blanks count none.

    ``raw`` may be a piece of the rows' bytes, from ``start``, of which n-grams that begin before ``stop`` count.
    """
    n = len(raw)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = FOLD[raw]
    row = textvec.rows_of(offsets, start, n)
    two = (c[:-1] << 8) | c[1:]
    blank = two == 0x2020
    found = []
    for size in (3, 4):
        m = min(n - size + 1, n if stop is None else stop)
        if m < 1:
            continue
        code = two[:m] * np.uint32(65536) + (c[2:] if size == 3 else two[2:])[:m] * np.uint32(1 if size == 4 else 256) + np.uint32(size)
        ok = (row[:m] == row[size - 1 :][:m]) & ~blank[:m] & ~blank[size - 2 :][:m]
        mixed = code[ok] * np.uint32(2654435761)
        found.append((((mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(16)) % np.uint32(buckets), row[:m][ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([b for b, _ in found]).astype(np.int64), np.concatenate([r for _, r in found])


def features(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(rows x buckets shares of the n-grams, neutral ones among them; numbers of n-grams)."""
    raw, offsets = textvec.buffers(column)
    rows = len(offsets) - 1
    x = np.zeros(rows * buckets, np.int64)
    for start, piece in textvec.pieces(raw, 3):
        b, row = subwords(piece, offsets, buckets, start, textvec.BLOCK_BYTES if start + len(piece) < len(raw) else None)
        x += np.bincount(row * buckets + b, minlength=rows * buckets)
    x = x.reshape(rows, buckets).astype(np.float32)
    n = x.sum(axis=1)
    return x / (n + NEUTRAL)[:, None], n.astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: the embeddings times the softmax's weights
    bias: np.ndarray
    temperature: float
    least: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.table + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def snippets(texts: list[str], seed: int) -> list[str]:
    """A random span of 8 to 120 characters of each text."""
    rng = np.random.default_rng(seed)
    out = []
    for t in texts:
        size = int(rng.integers(8, 121))
        at = int(rng.integers(0, max(1, len(t) - size)))
        out.append(t[at : at + size])
    return out


def train(texts: list[str], langs: list[str], dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> Model:
    """Stochastic gradient descent on four fifths of the texts and a snippet of each; the rest sets temperature and the least confidence.

    ``least`` is the smallest confidence at and above which the held-out
    snippets and texts are right in at least PRECISION of cases.
    """
    names = sorted(set(langs))
    y = np.array([names.index(k) for k in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held, kept = order[: len(order) // 5], order[len(order) // 5 :]

    def both(at: np.ndarray) -> np.ndarray:
        rows = [texts[i] for i in at]
        batch = pa.RecordBatch.from_arrays([pa.array(rows + snippets(rows, seed), pa.string())], ["text"])
        return np.concatenate([np.zeros((0, BUCKETS), np.float32), *(features(part.column(0))[0] for part in textvec.blocks(batch, rows=256))])

    x, yx = both(kept), np.concatenate([y[kept], y[kept]])
    emb = rng.normal(0, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    w = rng.normal(0, 1, (dim, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    one = np.eye(len(names), dtype=np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        perm = rng.permutation(len(x))
        for a in range(0, len(x), 32):
            i = perm[a : a + 32]
            xi = x[i]
            v = xi @ emb
            z = v @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - one[yx[i]]) / len(i)
            gv = g @ w.T
            w -= step * v.T @ g
            bias -= step * 0.1 * g.sum(axis=0)
            emb -= step * 40 * (xi.T @ gv)  # shares are small: as if a bucket's gradient weren't divided by the text's length
    model = Model(names, emb @ w, bias, 1.0, 0.0)
    xh, yh = both(held), np.concatenate([y[held], y[held]])
    if len(yh):
        loss = {}
        for t in np.geomspace(0.25, 8, 41):
            model.temperature = float(t)
            p = model.probabilities(xh)
            loss[float(t)] = -np.log(np.maximum(p[np.arange(len(yh)), yh], 1e-12)).mean()
        model.temperature = min(loss, key=loss.get)
        p = model.probabilities(xh)
        sure, right = p.max(axis=1), p.argmax(axis=1) == yh
        at = np.argsort(-sure)
        good = np.flatnonzero(np.cumsum(right[at]) >= PRECISION * np.arange(1, len(at) + 1))
        model.least = float(sure[at][good[-1]]) if len(good) else 1.0
    return model


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """At most ``per_language`` texts of each of the LANGUAGES most frequent languages, and about SAMPLE in all: those with the smallest hashes of id and text, rows equal in both once."""
    known = docs.where("lang IS NOT NULL AND length(text) > 0").select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", "text").alias("h"))
    names = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()  # bounded
    if not names:
        return [], []
    each = max(1, min(per_language, SAMPLE // len(names)))
    # Only languages and hashes are shuffled and ranked; the texts are picked by them where they are read.
    wanted = known.where(F.col("lang").isin([r["lang"] for r in names])).select("lang", "h").distinct()
    ranked = wanted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    chosen = ranked.where(F.col("rank") <= each).select("lang", "h")
    rows = known.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).toPandas()  # at most SAMPLE rows
    rows = rows.sort_values(["lang", "h"])
    return rows["text"].tolist(), rows["lang"].tolist()


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_id, confidence, n_grams) of every row; one narrow pass.

    ``lang_id`` is the likeliest language, or "und" where its calibrated
    probability is below ``model.least``: rejected.  Defined cases: a null or
    empty text, or one without letters, has no n-grams and is rejected at the
    confidence of the bias alone; null doc_ids and repeated rows get a row each;
    texts are read whole whatever their length; other columns are ignored; an
    empty table gives no rows.
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in textvec.blocks(batch, rows=256):
                x, n = features(part.column(1))
                p = m.probabilities(x)
                best, sure = p.argmax(axis=1), p.max(axis=1)
                name = [m.languages[b] if s >= m.least and k else NONE for b, s, k in zip(best, sure, n, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(name, pa.string()), pa.array(sure.astype(np.float64)), pa.array(n)], ["doc_id", "lang_id", "confidence", "n_grams"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {doc_type}, lang_id string, confidence double, n_grams bigint")


def identify_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Trains on a bounded sample of the rows' own ``lang`` and identifies every row; without any labelled text all rows are "und"."""
    texts, langs = training_sample(docs, per_language)
    model = train(texts, langs) if texts else Model([NONE], np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), 1.0, 2.0)
    return identify(docs, model)
