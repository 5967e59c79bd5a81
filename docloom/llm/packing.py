"""Packing documents into windows by non-negative least squares over the histogram of lengths."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_words, reliable

WINDOW = 2048
BINS = 128
DEPTH = 3
#: Pieces of one length that a task sorts; those of a frequent length are ranked in parts of about so many.
PER_PART = 200_000


def combinations(bins: int, depth: int) -> np.ndarray:
    """bins x strategies: how often each length (1..bins, column 0 is length 1) occurs in each multiset of up to ``depth`` lengths that fills a window."""
    found = [c for k in range(1, depth + 1) for c in itertools.combinations_with_replacement(range(1, bins + 1), k - 1) if 0 < bins - sum(c) and (not c or bins - sum(c) >= c[-1])]
    out = np.zeros((bins, len(found)))
    for j, c in enumerate(found):
        for length in (*c, bins - sum(c)):
            out[length - 1, j] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """argmin ||a x - b|| over x >= 0 (Lawson and Hanson's active sets)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-10 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(most or 6 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        j = int(np.argmax(gradient))
        if gradient[j] <= tolerance:
            break
        passive[j] = True
        while True:
            on = np.flatnonzero(passive)
            s = np.zeros(n)
            s[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            low = on[s[on] <= 1e-12]
            if not len(low):
                x = s
                break
            step = min(x[i] / (x[i] - s[i]) if x[i] != s[i] else 0.0 for i in low)
            x = x + step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                break
    return x


def pack_plan(histogram: dict[int, int], bins: int, depth: int = DEPTH) -> list[tuple[int, dict[int, int]]]:
    """[(repeats, {length: times in one pack})] that uses up the histogram exactly, no pack over ``bins``.

    Non-negative least squares gives the repeats of the shallow combinations;
    they are rounded, held to what is there, and the rest is packed greedily:
    longest first into the fullest pack that still has room, all packs of one
    filling at a time.  The work depends on ``bins``, never on the counts.
    """
    left = np.zeros(bins, np.int64)
    for length, count in histogram.items():
        left[length - 1] = count
    plan: list[tuple[int, dict[int, int]]] = []
    if left.sum():
        a = combinations(bins, depth)
        repeats = np.rint(nnls(a, left / left.max()) * left.max()).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            uses = np.flatnonzero(a[:, j])
            if repeats[j] <= 0:
                break
            n = min(int(repeats[j]), *(int(left[u] // int(a[u, j])) for u in uses))
            if n > 0:
                plan.append((n, {int(u) + 1: int(a[u, j]) for u in uses}))
                left[uses] -= n * a[uses, j].astype(np.int64)
    room: dict[int, list[tuple[int, dict[int, int]]]] = {}
    for length in range(bins, 0, -1):
        count = int(left[length - 1])
        while count:
            space = min((s for s, packs in room.items() if s >= length and packs), default=None)
            if space is None:
                space, each = bins, bins // length
                n, inside = max(1, count // each), {}
                each = min(each, count)
            else:
                packs, inside = room[space].pop()
                each = min(space // length, max(1, count // packs))
                n = min(packs, count // each)
                if n < packs:
                    room[space].append((packs - n, inside))
            count -= n * each
            now = dict(inside)
            now[length] = now.get(length, 0) + each
            room.setdefault(space - each * length, []).append((n, now))
    plan += [p for packs in room.values() for p in packs]
    return plan


def longs(rows: list[tuple[int, ...]], *names: str) -> pa.Table:
    return pa.table({n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(names)})


def pieces_of(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, start, length): every document cut into full windows and a rest, in words."""
    sized = docs.select("doc_id", n_words(F.col("text")).cast("bigint").alias("n")).where("n > 0")
    cut = sized.withColumn("start", F.explode(F.expr(f"sequence(0L, n - 1, {window}L)")))
    return cut.select("doc_id", "start", F.least(F.lit(window), F.col("n") - F.col("start")).cast("bigint").alias("length"))


def pack_documents(docs: DataFrame, window: int = WINDOW, bins: int = BINS, depth: int = DEPTH, per_part: int = PER_PART) -> DataFrame:
    """One row per pack: (pack_id, n_pieces, n_tokens, doc_ids, pieces).

    ``pieces`` are structs (doc_id, start, length) in words, in the order of the
    pack; ``doc_ids`` repeats their ids.  Lengths are rounded up to window/bins
    words, their histogram goes to the driver (a count for each bin and for every
    PER_PART pieces), which solves for the packs; pieces of one length are
    interchangeable, so the k-th of them, counted by prefix sums over the parts,
    takes the k-th slot for that length.  Only ids and lengths are shuffled.

    Defined cases: null or empty texts have no tokens and are in no pack; a
    document longer than the window gives full windows and a rest; null doc_ids
    are packed like others; repeated rows are packed each; an empty table gives
    no rows.  Other columns are ignored.
    """
    if window % bins:
        raise ValueError("window must be a multiple of bins")
    step = window // bins
    spark = docs.sparkSession
    pieces = pieces_of(docs, window).withColumn("bin", F.ceil(F.col("length") / step).cast("int"))
    pieces = reliable(pieces)
    many = {r["bin"]: -(-r["count"] // per_part) for r in pieces.groupBy("bin").count().collect()}  # a row per bin
    parts = F.element_at(F.lit([many.get(b, 1) for b in range(1, bins + 1)]), F.col("bin"))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), parts).cast("int"))
    counts = sorted((r["bin"], r["part"], r["count"]) for r in pieces.groupBy("bin", "part").count().collect())
    histogram: dict[int, int] = {}
    offsets = []
    for b, part, count in counts:
        offsets.append((b, part, histogram.get(b, 0)))
        histogram[b] = histogram.get(b, 0) + count
    slots, first, used = [], 0, dict.fromkeys(histogram, 0)
    for repeats, inside in pack_plan(histogram, bins, depth):
        at = 0
        for length in sorted(inside, reverse=True):
            times = inside[length]
            slots.append((length, used[length], used[length] + repeats * times, first, times, at))
            used[length] += repeats * times
            at += times
        first += repeats
    # As Arrow tables, which need no Python worker: those of lists would be further ones beside those of map_arrow.
    # Both have a row for each bin and a few more: for each combination used, and for every PER_PART pieces.
    slot_rows = F.broadcast(spark.createDataFrame(longs(slots, "s_bin", "s_from", "s_to", "s_pack", "s_times", "s_at")))
    offset_rows = F.broadcast(spark.createDataFrame(longs(offsets, "o_bin", "o_part", "o_rank")))
    ranked = pieces.withColumn("local", F.row_number().over(Window.partitionBy("bin", "part").orderBy("doc_id", "start", "length")) - 1)
    ranked = ranked.join(offset_rows, (F.col("bin") == F.col("o_bin")) & (F.col("part") == F.col("o_part"))).withColumn("rank", F.col("o_rank") + F.col("local"))
    placed = ranked.join(slot_rows, (F.col("bin") == F.col("s_bin")) & (F.col("rank") >= F.col("s_from")) & (F.col("rank") < F.col("s_to")))
    placed = placed.select(
        F.expr("s_pack + (rank - s_from) div s_times").alias("pack_id"),
        F.struct((F.col("s_at") + (F.col("rank") - F.col("s_from")) % F.col("s_times")).alias("slot"), "doc_id", "start", "length").alias("p"),
    )
    packs = placed.groupBy("pack_id").agg(F.array_sort(F.collect_list("p")).alias("p"), F.sum("p.length").alias("n_tokens"))
    return packs.select(
        "pack_id",
        F.size("p").cast("bigint").alias("n_pieces"),
        "n_tokens",
        F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"))).alias("pieces"),
    )
