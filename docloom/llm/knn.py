"""Quality classifier: neighbours among labelled latent-semantic vectors vote."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import map_arrow
from . import textvec
from .common import hidden

SHAPES = 2048
WORDS = 2048
EXTRA = 2
WIDTH = SHAPES + WORDS + EXTRA
DIM = 48
#: Bound of the labelled sample.
LABELLED = 4000
NEIGHBOURS = 15
#: A document is rejected if its neighbours' weighted votes for quality are below this share.
LEAST = 0.4
#: Similarities are raised to this power before they weigh a vote.
SHARPNESS = 8
#: Documents whose terms and cosines are held at once.
ROWS = 512
#: Decimals of cosines and scores.
DIGITS = 5


def _classes() -> np.ndarray:
    b = np.arange(256)
    out = b.copy()
    out[(b >= 97) & (b <= 122) | (b >= 128)] = ord("a")
    out[(b >= 65) & (b <= 90)] = ord("A")
    out[(b >= 48) & (b <= 57)] = ord("0")
    return out.astype(np.uint32)


CLASS = _classes()


def terms(column: pa.Array) -> np.ndarray:
    """rows x WIDTH: square roots of the shares of each row's terms, so that a row's length doesn't matter.

    Terms are trigrams of character classes (shapes), words, and two for
    repetition: words equal to the one before, and to the one a dozen before;
    shapes and words are hashed.
    """
    raw, offsets = textvec.buffers(column)
    rows, n = len(offsets) - 1, len(raw)
    out = np.zeros((rows, WIDTH), np.float32)
    if n == 0:
        return out
    if n >= 3:
        x = np.zeros(rows * SHAPES, np.int64)
        for start, piece in textvec.pieces(raw, 2):
            c = CLASS[piece]
            code = (c[:-2] << 16) | (c[1:-1] << 8) | c[2:]
            mixed = code * np.uint32(2654435761)
            bucket = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(16)) % np.uint32(SHAPES)
            row = textvec.rows_of(offsets, start, len(piece))
            ok = row[:-2] == row[2:]
            x += np.bincount(row[:-2][ok] * SHAPES + bucket[ok].astype(np.int64), minlength=rows * SHAPES)
        x = x.reshape(rows, SHAPES)
        out[:, :SHAPES] = np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1))
    w, at = textvec.words(raw, offsets)
    if len(w):
        x = np.bincount(at * WORDS + (w % np.uint64(WORDS)).astype(np.int64), minlength=rows * WORDS).reshape(rows, WORDS)
        total = np.maximum(x.sum(axis=1), 1)
        out[:, SHAPES : SHAPES + WORDS] = np.sqrt(x / total[:, None])
        same = (w[1:] == w[:-1]) & (at[1:] == at[:-1])
        out[:, SHAPES + WORDS] = np.sqrt(np.bincount(at[1:][same], minlength=rows) / total)
        if len(w) > 12:  # a word equal to the one a dozen words before, seldom outside repeated lines
            far = (w[12:] == w[:-12]) & (at[12:] == at[:-12])
            out[:, SHAPES + WORDS + 1] = np.sqrt(np.bincount(at[12:][far], minlength=rows) / total)
    return out


@dataclass
class Model:
    projection: np.ndarray  # WIDTH x dim, inverse document frequencies included
    vectors: np.ndarray  # labelled x dim, of length 1
    good: np.ndarray  # labelled
    neighbours: int = NEIGHBOURS

    def project(self, x: np.ndarray) -> np.ndarray:
        v = x @ self.projection
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, column: pa.Array) -> np.ndarray:
        """Share of the neighbours' weighted votes that are for quality; 1 where nothing can be said."""
        v = self.project(terms(column))
        cosine = np.round(v @ self.vectors.T, DIGITS)  # so that equal texts have equal votes in any block
        k = min(self.neighbours, cosine.shape[1])
        last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        above, level = cosine > last, cosine == last
        chosen = above | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True)))  # of a tie the first
        near = np.nonzero(chosen)[1].reshape(len(cosine), k)
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        return np.round(np.where(total > 0, (weight * self.good[near]).sum(axis=1) / np.maximum(total, 1e-300), 1.0), DIGITS)


def latent(x: np.ndarray, dim: int, seed: int = 3) -> np.ndarray:
    """WIDTH x dim right singular vectors of the terms weighted by inverse document frequency (randomised range finder), weights included."""
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    a = x * idf
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(a.shape[1], min(dim + 16, *a.shape))).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(a.T @ (a @ q))
    _, _, vt = np.linalg.svd(a @ q, full_matrices=False)
    return (idf[:, None] * (q @ vt.T[:, :dim])).astype(np.float32)


def train(texts: list[str], good: list[int], dim: int = DIM, neighbours: int = NEIGHBOURS) -> Model:
    rows = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    x = np.concatenate([terms(part.column(0)) for part in textvec.blocks(rows)])
    model = Model(latent(x, dim), np.zeros((0, dim), np.float32), np.array(good, np.float64), neighbours)
    model.vectors = model.project(x).astype(np.float32)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> tuple[list[str], list[int]]:
    """Texts and qualities of at most ``bound`` labelled documents, those with the smallest hashes of their id."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("good"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)  # bounded, whatever the corpus
    texts = docs.select("doc_id", "text").where("text IS NOT NULL AND text != ''")
    # One text of each id, so that no more than ``bound`` rows leave the executors however often a row is repeated.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("good").alias("good")).toPandas()
    rows = rows.sort_values("doc_id")
    return rows["text"].tolist(), (rows["good"] > 0).astype(int).tolist()


def score(docs: DataFrame, model: Model | None, name: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and the score; texts pass through Python once, in blocks, and nothing is shuffled."""
    schema = docs.schema
    out_type = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", `{name}` double"
    at = schema.fieldNames().index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LABELLED x DIM and WIDTH x DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in textvec.blocks(batch, batch.schema.names[at], rows=ROWS):
                s = m.scores(part.column(at)) if m is not None and len(m.good) else np.ones(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], [*part.schema.names, name])

    return map_arrow(docs, run, out_type)


def filter_quality(docs: DataFrame, labels: DataFrame, least: float = LEAST, bound: int = LABELLED) -> DataFrame:
    """The documents that their neighbours' votes don't reject, with all columns of ``docs``.

    The model is made of at most ``bound`` labelled documents: latent-semantic
    vectors by a singular value decomposition of their terms, broadcast to every
    task; each document's cosines with all of them are exact matrix products in
    blocks, the NEIGHBOURS nearest vote with weight cosine ** SHARPNESS.

    Defined cases: null, empty and wordless texts have no vector, score 1 and
    stay; labels of null ids or null quality are ignored, of several for one id
    the largest counts; a label without a document is ignored; without labels
    all documents stay; equal texts have equal scores; ties among neighbours
    count in the labelled sample's order of doc_id; very long texts are read
    whole; an empty table gives no rows.
    """
    (name,) = hidden(docs, "quality_score")
    texts, good = labelled_sample(docs, labels, bound)
    return score(docs, train(texts, good) if texts else None, name).where(F.col(name) >= least).select(*docs.columns)


def kept_scores(docs: DataFrame, labels: DataFrame, least: float = LEAST, bound: int = LABELLED) -> DataFrame:
    """(doc_id, quality_score) of the documents that stay."""
    texts, good = labelled_sample(docs, labels, bound)
    rows = score(docs.select("doc_id", "text"), train(texts, good) if texts else None)
    return rows.where(F.col("quality_score") >= least).select("doc_id", "quality_score")
