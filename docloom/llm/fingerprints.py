"""Document fingerprints: bottom-k sketches of shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import map_arrow
from . import textvec
from .common import hidden, if_small, reliable

K = 128
SHINGLE = 5
SPAN = float(1 << 63)


def bottom_k(raw: np.ndarray, offsets: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each row's k smallest distinct shingle hashes, 63 bits wide, ascending."""
    rows = len(offsets) - 1
    h, row = textvec.shingles(raw, offsets, n)
    h, at = textvec.distinct(h >> np.uint64(1), row, rows)
    count = np.diff(at)
    keep = np.arange(len(h)) - np.repeat(at[:-1], count) < k
    return h[keep].astype(np.int64), np.concatenate([[0], np.cumsum(np.minimum(count, k))])


def fingerprint(docs: DataFrame, k: int = K, n: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, sketch) of every row; no shuffle.

    ``sketch`` has the k smallest hashes of the text's distinct word n-grams;
    ``n_shingles`` is their number, exact below k and estimated from the k-th
    hash otherwise.  Words are runs of ASCII letters, digits and non-ASCII
    characters, without regard to ASCII case.

    Defined cases: a text of fewer than n words has one shingle of all of them;
    a null or empty text, or one without words, has an empty sketch and 0
    shingles; repeated rows and null doc_ids get a row each; very long texts are
    read whole; other columns are ignored; an empty table gives no rows.
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.blocks(batch):
                h, at = bottom_k(*textvec.buffers(part.column(1)), k, n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h))], ["doc_id", "sketch"])

    out = map_arrow(docs.select("doc_id", "text"), run, f"doc_id {doc_type}, sketch array<bigint>")
    return out.select("doc_id", distinct_count("sketch", k).alias("n_shingles"), "sketch")


def distinct_count(sketch: str | Column, k: int = K) -> Column:
    """Number of distinct shingles: the sketch's own size if it isn't full, else (k - 1) / (share of the hash range up to its last hash)."""
    s = F.col(sketch) if isinstance(sketch, str) else sketch
    full = F.round((k - 1) * SPAN / F.greatest(F.element_at(s, -1).cast("double"), F.lit(1.0))).cast("bigint")
    return F.when(F.size(s) < k, F.size(s).cast("bigint")).otherwise(full)


def union_sketch(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: share of the union's bottom k that both have; two empty sketches give 0."""
    u = union_sketch(a, b, k)
    return F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.greatest(F.size(u), F.lit(1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, in [0, 1]; an empty a gives 0."""
    both = resemblance(a, b, k) * distinct_count(union_sketch(a, b, k), k)
    return F.least(F.lit(1.0), both / F.greatest(distinct_count(a, k), F.lit(1)))


def merge(sketches: DataFrame, *keys: str, k: int = K, salts: int = 64) -> DataFrame:
    """(keys, n_shingles, sketch): the sketch of the union of all parts with equal keys, the same as if made from all their shingles.

    Three rounds, each of which sends no more than k hashes of a key from a
    partition: within the partitions in which the parts are, within ``salts``
    partitions of a key, and of these.  So a key with many parts isn't gathered
    whole.  Null keys form one group; keys whose parts are all empty have an
    empty sketch.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sketches.select(*keys).schema)
    schema = kinds + ", sketch array<bigint>"
    n = len(keys)

    def rows(held: dict, types: list[pa.DataType]) -> pa.RecordBatch:
        columns = [pa.array([key[i] for key in held], t) for i, t in enumerate(types)]
        batch = pa.RecordBatch.from_arrays([*columns, pa.array([v.tolist() for v in held.values()], pa.list_(pa.int64()))], [*keys, "sketch"])
        held.clear()
        return batch

    def run(batches: Iterator[pa.RecordBatch], ordered: bool) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.column(i).type for i in range(n)]
            lists = batch.column(n)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            empty = np.zeros(0, np.int64)
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(n)), strict=True)):
                if ordered and key not in held and len(held) >= 4096:  # keys come one after the other
                    last = held.popitem()
                    yield rows(held, types)
                    held[last[0]] = last[1]
                mine = flat[at[i] : at[i + 1]] if lists.is_valid()[i].as_py() else empty
                held[key] = np.union1d(held[key], mine)[:k] if key in held else np.unique(mine)[:k]
            if not ordered and len(held) >= 65536:
                yield rows(held, types)
        if held:
            yield rows(held, types)

    each = map_arrow(sketches.select(*keys, "sketch"), lambda b: run(b, False), schema)
    salted = each.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    some = map_arrow(salted.repartition(*keys, "_salt").sortWithinPartitions(*keys).select(*keys, "sketch"), lambda b: run(b, True), schema)
    out = map_arrow(some.repartition(*keys).sortWithinPartitions(*keys), lambda b: run(b, True), schema)
    return out.select(*keys, distinct_count("sketch", k).alias("n_shingles"), "sketch")


#: Sketches of items that a task holds at once.
ITEM_BLOCK = 8192


def count_of(sketch: np.ndarray, k: int) -> float:
    return float(len(sketch)) if len(sketch) < k else float(np.round((k - 1) * SPAN / max(float(sketch[-1]), 1.0)))


def estimates(a: np.ndarray, b: np.ndarray, k: int = K) -> tuple[float, float]:
    """(resemblance, containment of a in b) of two sketches, as the column functions have them."""
    u = np.union1d(a, b)[:k]
    same = len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), u, assume_unique=True)) / max(1, len(u))
    return same, min(1.0, same * count_of(u, k) / max(1.0, count_of(a, k)))


def nearest_items(sketches: DataFrame, items: DataFrame, k: int = K, block: int = ITEM_BLOCK) -> DataFrame:
    """Adds item_id, item_resemblance and item_containment to sketches of documents: the item most contained in each, by estimate; null where no hash is shared.

    ``items`` are (doc_id, sketch).  They are a query set: every document meets
    all of them, in blocks of ``block`` that a task holds.  Ties go to the
    greater resemblance, then to the smaller id.
    """
    id_type = items.schema["doc_id"].dataType.simpleString()
    plain = sketches.columns
    out = sketches.selectExpr("*", f"CAST(NULL AS {id_type}) AS item_id", "CAST(NULL AS double) AS item_resemblance", "CAST(NULL AS double) AS item_containment")
    schema = out.schema
    at = plain.index("sketch")
    items = items.where("doc_id IS NOT NULL AND size(sketch) > 0")
    blocks = -(-items.count() // block)
    for b in range(blocks):
        some = items.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == b).select("doc_id", "sketch").collect() if blocks > 1 else items.select("doc_id", "sketch").collect()
        shared = sketches.sparkSession.sparkContext.broadcast([(r["doc_id"], np.array(r["sketch"], np.int64)) for r in some])  # about ``block`` sketches

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            them = shared.value
            flat = np.concatenate([s for _, s in them]) if them else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(them)), [len(s) for _, s in them])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for batch in batches:
                lists = batch.column(at)
                offsets, hashes = lists.offsets.to_numpy(), lists.values.to_numpy()
                row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                hashes = hashes[offsets[0] : offsets[-1]]
                lo, hi = np.searchsorted(flat, hashes, "left"), np.searchsorted(flat, hashes, "right")
                hit = np.flatnonzero(hi > lo)
                pairs = {(int(row[h]), int(owner[j])) for h in hit for j in range(lo[h], hi[h])}
                best = [tuple(v) if v[0] is not None else None for v in zip(*(batch.column(len(plain) + c).to_pylist() for c in range(3)), strict=True)]
                for i, j in pairs:
                    same, inside = estimates(them[j][1], hashes[offsets[i] - offsets[0] : offsets[i + 1] - offsets[0]], k)
                    if same > 0 and (best[i] is None or (-inside, -same, them[j][0]) < (-best[i][2], -best[i][1], best[i][0])):
                        best[i] = (them[j][0], same, inside)
                found = list(zip(*(v or (None, None, None) for v in best), strict=True)) or [(), (), ()]
                kinds = [batch.column(len(plain) + c).type for c in range(3)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(plain)], *(pa.array(v, t) for v, t in zip(found, kinds, strict=True))], batch.schema.names)

        out = map_arrow(out, run, schema)
    return out


def fingerprints_compared(docs: DataFrame, items: DataFrame, k: int = K, n: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, sketch, source_shingles, item_id, item_resemblance, item_containment) of every row.

    ``source_shingles`` estimates the distinct shingles of all documents of the
    row's source, from their merged sketches; ``item_id`` is the item of
    ``items`` (item_id, text) most contained in the document, as nearest_items
    says.  Cases are those of fingerprint; a null source is one of its own.
    """
    (source,) = hidden(docs.select("doc_id"), "source")
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    kind = docs.schema["source"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.blocks(batch):
                h, at = bottom_k(*textvec.buffers(part.column(1)), k, n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h))], ["doc_id", source, "sketch"])

    each = map_arrow(docs.select("doc_id", "text", F.col("source").alias(source)), run, f"doc_id {doc_type}, {source} {kind}, sketch array<bigint>")
    each = reliable(each)
    whole = merge(each, source, k=k).select(F.col(source).alias("of"), F.col("n_shingles").alias("source_shingles"))
    rows = each.join(if_small(reliable(whole)), F.col(source).eqNullSafe(F.col("of"))).select("doc_id", distinct_count("sketch", k).alias("n_shingles"), "sketch", "source_shingles")
    return nearest_items(rows, fingerprint(items.select(F.col("item_id").alias("doc_id"), "text"), k, n), k)
