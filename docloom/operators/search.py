"""Exact vector search for any number of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidInput
from ..folders import cut
from ..functions import vectors
from ..workers import map_arrow
from .ranks import codes, leading

#: Vectors of a block; queries of it that are multiplied at once, by which products are 8 MB.
BLOCK, ROWS = 2048, 512
#: Bytes of packed queries, and of the hits that a task keeps for them, up to which they are sent to all executors.
BROADCAST_BYTES = 64 << 20


def _blocks(df: DataFrame, id_col: str, vec_col: str, name: str) -> DataFrame:
    """(name_ids, name_matrix): vectors packed into blocks of about BLOCK rows, ids as they are; rows without a vector or an id are left out."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                lists, ids = part.column(1), part.column(0)
                sizes = set(np.diff(lists.offsets.to_numpy()))
                if len(sizes) > 1:
                    raise InvalidInput("vectors differ in length")
                matrix = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([matrix.tobytes()], pa.binary())], [f"{name}_ids", f"{name}_matrix"])

    rows = df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, vec_col)
    return map_arrow(rows, run, f"{name}_ids array<{id_type}>, {name}_matrix binary")


def knn(queries: DataFrame, base: DataFrame, k: int = 10, metric: str = "cosine", query_id: str = "query_id", base_id: str = "vec_id", query_vec: str = "embedding", base_vec: str = "embedding", digits: int = 6) -> DataFrame:
    """(query_id, {base_id}, score, rank): the k best of ``base`` for each row of ``queries``, whose ids may be of any type.

    Both sides are packed into blocks, once; every pair of blocks is one matrix
    product.  The packed queries, with the hits kept for them, are counted: within
    BROADCAST_BYTES they are sent to all executors and vectors stay where they
    are, else they are dealt to parts of that size, of which a task has one.  It
    keeps the k best of each query over all its blocks and nothing else.  Scores
    are rounded, ties go to the smaller id.
    """
    if metric not in ("cosine", "l2_inverse"):
        raise InvalidInput(metric)
    q_type, b_type = (d.schema[c].dataType.simpleString() for d, c in ((queries, query_id), (base, base_id)))
    margin = 10.0**-digits  # more than rounding moves a score

    # Products are scores, or negative squared distances that scores grow with.
    def sides(q: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        qn, bn = (q * q).sum(axis=1)[:, None], (b * b).sum(axis=1)[:, None]
        if metric == "cosine":
            return q / np.maximum(np.sqrt(qn), 1e-150), b / np.maximum(np.sqrt(bn), 1e-150)
        return np.hstack([2 * q, -qn, np.ones_like(qn)]), np.hstack([b, np.ones_like(bn), -bn])

    def score_of(product: np.ndarray) -> np.ndarray:
        return np.round(product if metric == "cosine" else 1 / (1 + np.maximum(-product, 0)), digits)

    def product_below(score: np.ndarray) -> np.ndarray:
        """No product of a score as large is smaller."""
        low = score - margin
        return low if metric == "cosine" else np.where(low > 0, 1 - 1 / np.maximum(low, 1e-300), -np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[pa.Array, np.ndarray, np.ndarray, pa.Array | None, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                number, b_ids = batch.column(0)[i].as_py(), batch.column(3)[i].values
                if number not in kept:  # the ids are copied: what is kept of a batch keeps all of it
                    q_ids = batch.column(1)[i].values
                    kept[number] = (q_ids.take(pa.array(np.arange(len(q_ids)))), np.zeros(0, np.int64), np.zeros(0), None, np.full(len(q_ids), -np.inf))
                q_ids, row, score, ids, floor = kept[number]
                q, b = (np.frombuffer(batch.column(c)[i].as_buffer()).reshape(len(x), -1) for c, x in ((2, q_ids), (4, b_ids)))
                if q.shape[1] != b.shape[1]:
                    raise InvalidInput("vectors differ in length")
                q, b = sides(q, b)
                for at in range(0, len(q), ROWS):
                    some = slice(at, at + ROWS)
                    s = q[some] @ b.T
                    there = s >= floor[some, None]
                    if len(b) > k and np.count_nonzero(there) > 4 * k * len(s):
                        last = np.partition(s, len(b) - k, axis=1)[:, len(b) - k]
                        there &= s >= product_below(score_of(last))[:, None]
                    r, c = np.nonzero(there)
                    if not len(r):
                        continue
                    mine = (row >= at) & (row < at + ROWS)
                    used, place = np.unique(c, return_inverse=True)
                    old = ids.filter(pa.array(mine)) if ids is not None else b_ids.slice(0, 0)
                    docs = pa.concat_arrays([old, b_ids.take(pa.array(used))])
                    r, found, place = np.concatenate([row[mine], r + at]), np.concatenate([score[mine], score_of(s[r, c])]), np.concatenate([np.arange(len(old)), place + len(old)])
                    best = leading(r, found, codes(docs)[place], k)
                    docs = docs.take(pa.array(place[best]))
                    ids = docs if ids is None else pa.concat_arrays([ids.filter(pa.array(~mine)), docs])
                    row, score = np.concatenate([row[~mine], r[best]]), np.concatenate([score[~mine], found[best]])
                    low = np.full(len(q), np.inf)
                    np.minimum.at(low, r[best], found[best])
                    full = np.bincount(r[best], minlength=len(q)) >= k
                    floor[full] = product_below(low[full])
                kept[number] = (q_ids, row, score, ids, floor)
        for q_ids, row, score, ids, _ in kept.values():
            if ids is not None:
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(row)), ids, pa.array(score)], ["query_id", base_id, "score"])

    q = cut(_blocks(queries, query_id, query_vec, "q").withColumn("q_no", F.monotonically_increasing_id()))
    size = q.agg(F.sum(F.length("q_matrix") + (32 + 32 * k) * F.size("q_ids"))).first()[0] or 0
    b = _blocks(base, base_id, base_vec, "b")
    pairs = b.crossJoin(F.broadcast(q)) if size <= BROADCAST_BYTES else cut(b).crossJoin(q.repartition(-(-size // BROADCAST_BYTES)))
    found = map_arrow(pairs.select("q_no", "q_ids", "q_matrix", "b_ids", "b_matrix"), run, f"query_id {q_type}, `{base_id}` {b_type}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), base_id)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def topk(base: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", base_id: str = "vec_id", vec_col: str = "embedding", digits: int = 6) -> DataFrame:
    """``base`` with its score for one query, the k best; columns only, so the scan is pruned and the sort is a top-k."""
    q = F.array(*(F.lit(float(x)) for x in query))
    score = vectors.cosine(F.col(vec_col), q) if metric == "cosine" else vectors.l2_score(F.col(vec_col), q)
    return base.withColumn("score", F.round(score, digits)).orderBy(F.desc("score"), base_id).limit(k)
