"""N-gram Jaccard join: documents whose sets of word n-grams are near, the links between them and the groups that they form.

A metric-space join divides by pivots, copies what lies in a triangle window to
further regions, and joins the regions on.  Over a whole corpus documents can't
be the pivots: unrelated texts lie at a distance of 1 from any document, within
every window of width 2 (1 - t).  So the join has two levels.

Over the corpus the regions are those of single n-grams, the smallest sets of
the space, in a global order, rare before frequent.  A document lacks at most
|x| - ceil(t |x|) n-grams of one that is near to it, so the two have one of the
first |x| - ceil(t |x|) + 1 in common: these are the regions to which it is
copied.  What is found there connects documents into components, and no near
pair lies across two components.

Inside a component documents are near enough for pivots among themselves: there
``voronoi`` counts every link, by Voronoi regions and triangle windows, recursively.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workers import map_arrow
from . import textvec, voronoi
from .common import if_light, if_small, reliable, settled, small_steps

SHINGLE = 3
THRESHOLD = 0.5
#: Counters of the frequency sketch that orders the n-grams; any order gives the same result.
SLOTS = 1 << 24
CHUNK = 1 << 18
#: Documents of a region, in order of size, to which one is compared in the first round; what a larger region has beyond is joined in the second.
NEAR = 16
#: Bytes of postings in a partition of regions.
REGION_BYTES = 16 << 20
#: Bytes of postings kept by a task before they are sent on.
FLUSH_BYTES = 16 << 20
#: Partitions to which one shuffle sends; more are reached in two.
WIDE = 4096
#: Pairs up to which all are verified in one round.
ONE_ROUND = 2000

_U = np.uint64


def set_ids(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """64-bit identity of each row's bag of n-grams, whatever their order; 0 for none."""
    count = np.bincount(row, minlength=rows)
    out = np.zeros(rows, _U)
    some = np.flatnonzero(count)
    if len(some):
        at = np.concatenate([[0], np.cumsum(count)])[some]
        with np.errstate(over="ignore"):
            out[some] = textvec.mix64(np.add.reduceat(textvec.mix64(h + _U(0x51)), at) + count[some].astype(_U) * _U(0x9E3779B97F4A7C15))
        out[some] |= _U(1)
    return out


def text_blocks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in textvec.blocks(batch):
            yield part, *textvec.shingles(*textvec.buffers(part.column(part.schema.get_field_index("text"))), n)


def survey(docs: DataFrame, n: int) -> DataFrame:
    """Two kinds of rows: (key, doc_id, set_id) of each document and (chunk, counts) of each partition's frequency sketch."""
    doc_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.uint16)  # a counter that is full stays so; it only serves the order
        id_type = None
        for part, h, row in text_blocks(batches, n):
            rows = part.num_rows
            id_type = part.column(0).type
            slot, times = np.unique((h & _U(SLOTS - 1)).astype(np.uint32), return_counts=True)
            counts[slot] = np.minimum(counts[slot].astype(np.int64) + times, 65535)
            nothing = [pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(set_ids(h, row, rows).view(np.int64)), *nothing], NAMES)
        if id_type is not None:
            chunks = [c for c in range(SLOTS // CHUNK) if counts[c * CHUNK : (c + 1) * CHUNK].any()]
            blobs = [textvec.squeeze(counts[c * CHUNK : (c + 1) * CHUNK]) for c in chunks]
            none = [pa.nulls(len(chunks), t) for t in (id_type, pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(chunks, pa.int32()), pa.array(blobs, pa.binary())], NAMES)

    NAMES = ["doc_id", "key", "set_id", "chunk", "counts"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return map_arrow(rows, run, f"doc_id {doc_type.simpleString()}, key bigint, set_id bigint, chunk int, counts binary")


def frequency_classes(surveyed: DataFrame) -> list[tuple[int, bytes]]:
    """(chunk, packed classes): per slot of the sketch a class from 0, rare, to 255; less than SLOTS bytes, whatever the corpus, and packed while the driver has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[chunk] = sums.get(chunk, 0) + textvec.spread(blob.as_py(), np.uint16).astype(np.int64)
        classes = [textvec.squeeze(np.minimum(255, np.round(4 * np.log2(1 + s))).astype(np.uint8)) for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(classes, pa.binary())], ["chunk", "classes"])

    parts = surveyed.where("chunk IS NOT NULL").select("chunk", "counts").repartition(16, "chunk")
    return [(r["chunk"], bytes(r["classes"])) for r in map_arrow(parts, run, "chunk int, classes binary").collect()]


def class_table(packed_classes: list[tuple[int, bytes]]) -> np.ndarray:
    out = np.zeros(SLOTS, np.uint8)
    for chunk, blob in packed_classes:
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = textvec.spread(blob, np.uint8)
    return out


def ordered(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The n-grams as 64-bit numbers in the global order: class of frequency, then hash."""
    return (classes[(h & _U(SLOTS - 1)).astype(np.int64)].astype(_U) << _U(56)) | (h >> _U(8))


def overlap_needed(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Least overlap of sets of sizes a and b whose similarity is at least t."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9)


def postings(docs: DataFrame, classes: list[tuple[int, bytes]], n: int, t: float, parts: int) -> DataFrame:
    """(part, blob): each document's regions, as columns of numbers for all documents that a task has for a part."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = class_table(shared.value)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for part, h, row in text_blocks(batches, n):
            ids = set_ids(h, row, part.num_rows)
            token, at = textvec.distinct(ordered(h, table), row, part.num_rows)
            count = np.diff(at)
            place = np.arange(len(token)) - np.repeat(at[:-1], count)
            reach = count - np.ceil(t * count - 1e-9).astype(np.int64) + 1
            keep = place < np.repeat(reach, count)
            of = np.repeat(np.arange(part.num_rows), count)[keep]
            held.append((token[keep], ids[of], count[of].astype(np.uint32), np.minimum(place[keep], 65535).astype(np.uint16)))
            size += 22 * int(keep.sum())
            if size > FLUSH_BYTES:
                yield from flush(held)
                size = 0
        yield from flush(held)

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if held:
            token, ids, count, place = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            yield from packed(textvec.mix64(token), ids, count, place, parts, -(-parts // WIDE))

    return map_arrow(docs.select("text"), run, "part bigint, blob binary")


def packed(token: np.ndarray, ids: np.ndarray, count: np.ndarray, place: np.ndarray, parts: int, together: int) -> Iterator[pa.RecordBatch]:
    """(part, blob) of postings, one for each part, or each group of so many parts ``together``, that has any.

    Within a part 32 bits tell regions apart well enough: two that fall together
    only give candidates in vain.
    """
    if not len(token):
        return
    where = (token % _U(parts)).astype(np.int64) // together
    order = np.argsort(where, kind="stable")
    token, ids, count, place, where = token[order], ids[order], count[order], place[order], where[order]
    if together == 1:
        token = (token >> _U(32)).astype(np.uint32)
    cut = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]]))
    number, blobs = [], []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        sets, first, of = np.unique(ids[a:b], return_index=True, return_inverse=True)
        head = np.array([len(sets), b - a, token.itemsize], np.int64)
        number.append(int(where[a]))
        blobs.append(b"".join(x.tobytes() for x in (head, sets, count[a:b][first], token[a:b], of.astype(np.uint32), place[a:b])))
    yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(blobs, pa.binary())], ["part", "blob"])


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """(token, set id, size, place) of a blob's postings."""
    k, m, width = (int(v) for v in np.frombuffer(blob, np.int64, 3))
    at = 24
    sets = np.frombuffer(blob, _U, k, at)
    size = np.frombuffer(blob, np.uint32, k, at := at + 8 * k)
    token = np.frombuffer(blob, np.dtype(f"u{width}"), m, at := at + 4 * k)
    of = np.frombuffer(blob, np.uint32, m, at := at + width * m)
    place = np.frombuffer(blob, np.uint16, m, at + 4 * m)
    return token, sets[of], size[of], place


def by_part(blobs: DataFrame, parts: int) -> DataFrame:
    """Blobs with those of a part together, in one partition and one after the other; groups of parts are taken apart where they arrive."""

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(1):
                token, ids, size, place = unpack(blob.as_py())
                yield from packed(token, ids, size, place, parts, 1)

    out = blobs.repartition(min(parts, WIDE), "part")
    if parts > WIDE:
        out = map_arrow(out, refine, "part bigint, blob binary")
    return out.sortWithinPartitions("part")


def near_pairs(token: np.ndarray, ids: np.ndarray, size: np.ndarray, place: np.ndarray, t: float, near: int) -> tuple[np.ndarray, ...]:
    """(a, b, smaller size, larger size, common, ok, rest) of the regions in a part.

    Pairs a < b are members of a region at most ``near`` apart in order of size
    whose sizes allow t.  ``common`` counts their regions of at most near + 1
    members, in which every pair is seen; ``ok`` says whether the places of some
    common n-gram allow t.  ``rest`` are the postings of the larger regions.
    """
    order = np.lexsort((ids, size, token))
    token, ids, size, place = token[order], ids[order], size[order].astype(np.int64), place[order].astype(np.int64)
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | (ids[1:] != ids[:-1])  # copies have one posting
    order, token, ids, size, place = order[keep], token[keep], ids[keep], size[keep], place[keep]
    start = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, bool)
    region = np.cumsum(start) - 1
    members = np.bincount(region)[region] if len(token) else np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, ...]] = []
    left = np.flatnonzero(members > 1)
    for k in range(1, near + 1):
        left = left[left + k < len(token)]
        left = left[region[left] == region[left + k]]
        if not len(left):
            break
        x, y = left, left + k  # y is the larger
        fit = size[x] >= t * size[y] - 1e-9
        x, y = x[fit], y[fit]
        ok = 1 + np.minimum(size[x] - place[x] - 1, size[y] - place[y] - 1) >= overlap_needed(size[x], size[y], t)
        found.append((np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), size[x], size[y], (members[x] <= near + 1).astype(np.int64), ok))
    kinds = (_U, _U, np.int64, np.int64, np.int64, bool)
    a, b, lo, hi, common, ok = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, k) for k in kinds)
    by = np.lexsort((b, a))
    a, b, lo, hi, common, ok = (v[by] for v in (a, b, lo, hi, common, ok))
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    if len(first):
        common, ok = np.add.reduceat(common, first), np.logical_or.reduceat(ok, first)
    return a[first], b[first], lo[first], hi[first], common, ok, order[members > near + 1]


def candidates(blobs: DataFrame, t: float, parts: int, near: int) -> DataFrame:
    """Two kinds of rows: pairs (a, b, lo, hi, common, ok) as near_pairs has them; and, with a region, the members (a, lo: size, hi: place) of each large one."""

    NAMES = ["region", "a", "b", "lo", "hi", "common", "ok"]

    def joined(p: int, held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        token, ids, size, place = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        a, b, lo, hi, common, ok, rest = near_pairs(token, ids, size, place, t, near)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), *(pa.array(v) for v in (a.view(np.int64), b.view(np.int64), lo, hi, common, ok))], NAMES)
        region = token[rest].astype(np.int64) * parts + p
        columns = [pa.array(v) for v in (region, ids[rest].view(np.int64), size[rest].astype(np.int64), place[rest].astype(np.int64))]
        yield pa.RecordBatch.from_arrays([*columns[:2], pa.nulls(len(rest), pa.int64()), *columns[2:], pa.nulls(len(rest), pa.int64()), pa.nulls(len(rest), pa.bool_())], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p != now and held:
                    yield from joined(now, held)
                now = p
                held.append(unpack(blob.as_py()))
        if held:
            yield from joined(now, held)

    return map_arrow(by_part(blobs, parts), run, "region bigint, a bigint, b bigint, lo bigint, hi bigint, common bigint, ok boolean")


def promising(pairs: DataFrame, members: DataFrame, t: float) -> DataFrame:
    """(a, b, common) of the pairs that may have the overlap needed.

    It is at most: the n-grams that the two have in common among the first ones
    of each, which are those counted and, in large regions, as many as either
    has there; and the n-grams after the first ones of one of them.
    """
    large = members.groupBy("a").agg(F.count("*").alias("large"))
    p = pairs.join(large, "a", "left").join(large.select(F.col("a").alias("b"), F.col("large").alias("large_b")), "b", "left")
    most = F.col("common") + F.least(F.coalesce("large", F.lit(0)), F.coalesce("large_b", F.lit(0))) + F.ceil(t * F.col("hi") - 1e-9) - 1
    return p.where(most >= F.ceil(t / (1 + t) * (F.col("lo") + F.col("hi")) - 1e-9)).select("a", "b", "common")


def similar(pairs: DataFrame, docs: DataFrame, known: DataFrame, n: int, t: float) -> DataFrame:
    """(a, b) of the pairs whose exact Jaccard similarity is at least t.

    One document stands for each set.  It is read again, and its set is sent
    once to its own place, where it is a pair's first, and once for each pair
    in which it is the second, to the first's place: nothing else is shuffled.
    """
    to = pairs.groupBy(F.col("b").alias("set_id")).agg(F.collect_list("a").alias("to"))
    own = pairs.select(F.col("a").alias("set_id")).distinct().withColumn("own", F.lit(True))
    one = known.groupBy("set_id").agg(F.min(F.struct("doc_id", "key")).alias("d"))
    sends = one.join(to.join(own, "set_id", "full_outer"), "set_id")
    sends = reliable(sends.select(F.col("d.doc_id").alias("send_id"), F.col("d.key").alias("send_key"), "set_id", F.coalesce("own", F.lit(False)).alias("own"), F.coalesce("to", F.array().cast("array<bigint>")).alias("to")))
    rows = docs.select("text", F.col("doc_id"), F.xxhash64("text").alias("key"))
    rows = rows.join(if_light(sends, F.lit(48) + 8 * F.size("to")), F.col("doc_id").eqNullSafe(F.col("send_id")) & (F.col("key") == F.col("send_key"))).select("text", "set_id", "own", "to")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, row in text_blocks(batches, n):
            grams, at = textvec.distinct(h, row, part.num_rows)
            a, b, sets, held = [], [], [], 0
            for i, (me, mine, others) in enumerate(zip(*(part.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                blob = grams[at[i] : at[i + 1]].tobytes()
                for x, y in ([(me, None)] if mine else []) + [(o, me) for o in others]:
                    a.append(x), b.append(y), sets.append(blob)
                    held += len(blob)
                    if held > 4 * textvec.BLOCK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sets, pa.binary())], ["a", "b", "grams"])
                        a, b, sets, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sets, pa.binary())], ["a", "b", "grams"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine = None, np.zeros(0, _U)
        for batch in batches:
            out = ([], [])
            for a, b, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                theirs = np.frombuffer(grams.as_py(), _U)
                if b is None:
                    now, mine = a, theirs
                elif a == now:
                    both = len(np.intersect1d(mine, theirs, assume_unique=True))
                    if both >= t * (len(mine) + len(theirs) - both) - 1e-9:
                        out[0].append(a)
                        out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["a", "b"])

    sent = map_arrow(rows, send, "a bigint, b bigint, grams binary")
    return map_arrow(sent.repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first()), compare, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(set_id, label) of every vertex: the smallest set id of its connected component.

    In each round a vertex joins its smallest neighbour, if that is smaller, and
    follows whom that one joined to the end, by doubling steps; edges are drawn
    again between what is left.  Only vertices without a smaller neighbour
    remain, so that rounds are few.  Each step is cut with a checkpoint.
    """
    with small_steps(edges.sparkSession, edges.count()):
        return _components(edges)


def _components(edges: DataFrame) -> DataFrame:
    edges = settled(edges.select("a", "b").where("a != b").distinct())
    labels = settled(edges.select(F.col("a").alias("set_id")).union(edges.select("b")).distinct().withColumn("label", F.col("set_id")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        to = settled(both.groupBy("a").agg(F.min("b").alias("m")).where("m < a"))
        while True:  # twice as far each time, until all have arrived
            hops = to.join(to.select(F.col("a").alias("m"), F.col("m").alias("far")), "m", "left")
            if hops.where("far IS NOT NULL").isEmpty():
                break
            to = settled(hops.select("a", F.coalesce("far", "m").alias("m")))
        labels = settled(labels.join(to, labels["label"] == to["a"], "left").select("set_id", F.coalesce("m", "label").alias("label")))
        edges = edges.join(to, "a", "left").select(F.coalesce("m", "a").alias("a"), "b")
        edges = edges.join(to.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b", "left").select("a", F.coalesce("mb", "b").alias("b"))
        edges = settled(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels


def unconnected(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b, common) that lie in different components, with these, label_a and label_b; ids without a label are their own."""
    out = pairs.select("a", "b", "common")
    for side in ("a", "b"):
        out = out.join(if_small(labels.select(F.col("set_id").alias(side), F.col("label").alias(f"label_{side}"))), side, "left").withColumn(f"label_{side}", F.coalesce(f"label_{side}", side))
    return out.where("label_a != label_b")


def first_ones(pairs: DataFrame, most: int) -> DataFrame:
    """Of ``unconnected`` pairs, for each two components the ``most`` that share most."""
    order = Window.partitionBy(F.least("label_a", "label_b"), F.greatest("label_a", "label_b")).orderBy(F.desc("common"), "a", "b")
    return pairs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("a", "b")


#: Members of a region that a task holds; those of one with more are spread over several.
HELD = 20_000


def remaining_pairs(members: DataFrame, labels: DataFrame, counted: DataFrame, t: float, held: int = HELD) -> DataFrame:
    """(a, b) of the pairs of large regions that haven't been counted in any small one and lie in different components, as sizes, places and their numbers of large regions allow.

    The n-grams that the two have in common among the first of each all lie in
    large regions, so both need as many of these as a near pair has there at
    least.  In each region the members of the component with the most there are
    compared with the others only, not with each other: a task holds a part of
    the others, and all members stream past them.
    """
    large = members.groupBy("a").agg(F.count("*").alias("large"))
    m = members.join(labels.withColumnRenamed("set_id", "a"), "a", "left").withColumn("label", F.coalesce("label", "a")).join(large, "a")
    of = m.groupBy("region", "label").agg(F.count("*").alias("n")).groupBy("region").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("kinds"), (F.sum("n") - F.max("n")).alias("others"))
    m = m.join(of.where("kinds > 1").drop("kinds"), "region")
    shares = F.ceil(F.col("others") / held).cast("int")
    first = m.where("label != main").withColumn("share", F.pmod(F.xxhash64("a"), shares).cast("int")).withColumn("then", F.lit(False))
    then = m.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).withColumn("then", F.lit(True))
    columns = ["region", "share", "then", "a", "size", "place", "label", "large", "main"]
    rows = first.select(columns).union(then.select(columns)).repartition("region", "share").sortWithinPartitions("region", "share", "then")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple[int, int] | None = None
        mine: list[np.ndarray] = []
        for batch in batches:
            v = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(9)]
            cut = np.flatnonzero(np.concatenate([[True], (v[0][1:] != v[0][:-1]) | (v[1][1:] != v[1][:-1]) | (v[2][1:] != v[2][:-1]), [True]]))
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                at, part = (int(v[0][i]), int(v[1][i])), [c[i:j] for c in v[3:]]
                if not v[2][i]:
                    mine = [np.concatenate(c) for c in zip(mine, part, strict=True)] if here == at and mine else part
                    here = at
                elif here == at:
                    step = max(1, (1 << 21) // max(1, len(mine[0])))
                    for k in range(0, j - i, step):
                        yield matched(mine, [c[k : k + step] for c in part], t)

    pairs = map_arrow(rows, run, "a bigint, b bigint").distinct()
    return pairs.join(counted.select("a", "b"), ["a", "b"], "left_anti")


def matched(mine: list[np.ndarray], theirs: list[np.ndarray], t: float) -> pa.RecordBatch:
    """The pairs (a, b) of two lists of a region's members that may be near."""
    (a1, size1, place1, label1, large1, _), (a2, size2, place2, label2, large2, main2) = mine, theirs
    x, y = np.nonzero((label1[:, None] != label2[None, :]) & (np.minimum(size1[:, None], size2[None, :]) >= t * np.maximum(size1[:, None], size2[None, :]) - 1e-9))
    keep = (label2[y] == main2[y]) | (a1[x] < a2[y])  # two others meet twice
    x, y = x[keep], y[keep]
    need = overlap_needed(size1[x], size2[y], t)
    keep = (1 + np.minimum(size1[x] - place1[x] - 1, size2[y] - place2[y] - 1) >= need) & (np.minimum(large1[x], large2[y]) + np.ceil(t * np.maximum(size1[x], size2[y]) - 1e-9) - 1 >= need)
    # Ids are compared as they were packed, as numbers without a sign.
    a, b = a1[x[keep]].astype(np.int64).view(_U), a2[y[keep]].astype(np.int64).view(_U)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).view(np.int64)), pa.array(np.maximum(a, b).view(np.int64))], ["a", "b"])


def grouped(docs: DataFrame, t: float = THRESHOLD, n: int = SHINGLE, near: int = NEAR, one_round: int = ONE_ROUND) -> DataFrame:
    """(doc_id, key, set_id, label) of every document that has words; key is xxhash64(text), documents with one label form a group.

    More than ``one_round`` pairs are verified in rounds: what a few of them
    connect needn't be looked at again, and in a large family that is most.
    """
    docs = docs.select("doc_id", "text")
    surveyed = reliable(survey(docs, n))
    classes = frequency_classes(surveyed)
    known = surveyed.where("chunk IS NULL AND set_id != 0").select("doc_id", "key", "set_id")
    # A posting takes about 10 bytes, a word of text about 6.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(24, math.ceil(size / 6 * (1 - t) * 10 / REGION_BYTES))
    found = reliable(candidates(postings(docs, classes, n, t, parts), t, parts, near))
    pairs = found.where("region IS NULL").groupBy("a", "b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("common").alias("common"), F.max("ok").alias("ok"))
    pairs = reliable(pairs)
    members = found.where("region IS NOT NULL").select("region", "a", F.col("lo").alias("size"), F.col("hi").alias("place"))
    in_large = reliable(members.select("a").distinct())

    def joined(labels: DataFrame | None, more: DataFrame) -> DataFrame:
        """(set_id, label) after the near ones of further pairs are added; what is one component already is one vertex."""
        new = reliable(similar(more, docs, known, n, t))
        if labels is None:
            return components(new)
        if new.isEmpty():
            return labels
        ends = new
        for side in ("a", "b"):
            ends = ends.join(labels.select(F.col("set_id").alias(side), F.col("label").alias(f"{side}_of")), side, "left")
        whole = components(ends.select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")))
        of = labels.union(new.select("a", "a")).union(new.select("b", "b")).groupBy("set_id").agg(F.min("label").alias("label"))
        return settled(of.join(whole.select(F.col("set_id").alias("label"), F.col("label").alias("to")), "label", "left").select("set_id", F.coalesce("to", "label").alias("label")))

    def all_joined(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """The same for any number of pairs (a, b, common): first one, then a few for each two components, then what these haven't connected."""
        for most in (1, 8, None):
            pairs = settled(unconnected(pairs, labels))
            now = pairs.select("a", "b")
            if most and pairs.count() > one_round:
                now = settled(first_ones(pairs, most))
            else:
                most = None
            if not pairs.isEmpty():
                labels = joined(labels, now)
            if most is None:
                break
            pairs = pairs.join(now, ["a", "b"], "left_anti")
        return labels

    # First each set with the one that it shares most with; then what of the rest isn't connected by that.
    good = reliable(promising(pairs.where("ok"), members, t))
    labels = joined(None, reliable(good.groupBy("b").agg(F.max_by("a", F.struct("common", "a")).alias("a")).select("a", "b")))
    # Places that only a common n-gram of a large region allows: both need such regions.
    late = pairs.where("NOT ok")
    for side in ("a", "b"):
        late = late.join(if_small(in_large.select(F.col("a").alias(side))), side, "left_semi")
    labels = all_joined(labels, good.union(promising(late, members, t)))
    labels = all_joined(labels, remaining_pairs(members, labels, pairs, t).withColumn("common", F.lit(0)))
    return known.join(labels, "set_id", "left").select("doc_id", "key", "set_id", F.coalesce("label", "set_id").alias("label"))


def component_members(rows: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Each set of a component of several, once, with the number of its documents, as voronoi.MEMBERS."""
    one = rows.groupBy("label", "set_id").agg(F.min(F.struct("doc_id", "key")).alias("d"), F.count("*").alias("weight"))
    several = one.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
    one = reliable(one.join(several, "label", "left_semi").select("label", "set_id", "weight", F.col("d.doc_id").alias("send_id"), F.col("d.key").alias("send_key")))
    texts = docs.select("text", "doc_id", F.xxhash64("text").alias("key"))
    texts = texts.join(if_light(one, F.lit(48)), F.col("doc_id").eqNullSafe(F.col("send_id")) & (F.col("key") == F.col("send_key"))).select("text", "label", "set_id", "weight", "send_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, row in text_blocks(batches, n):
            grams, at = textvec.distinct(h, row, part.num_rows)
            blobs = [grams[at[i] : at[i + 1]].tobytes() for i in range(part.num_rows)]
            flags = [pa.array([v] * part.num_rows) for v in (False, True)]
            yield pa.RecordBatch.from_arrays([*part.columns[1:4], *flags, pa.array(blobs, pa.binary())], voronoi.NAMES)

    # A document that is there several times was read several times.
    return map_arrow(texts, run, voronoi.MEMBERS).dropDuplicates(["cell", "set_id"])


def near_duplicates(docs: DataFrame, t: float = THRESHOLD, n: int = SHINGLE) -> DataFrame:
    """(group_id, doc_id, n_docs, n_links) of every document in a group of two or more.

    Two documents are near if the Jaccard similarity of their sets of word
    n-grams is at least t; groups are the connected components of nearness,
    ``group_id`` is the smallest doc_id in them, ``n_docs`` their size and
    ``n_links`` the number of other documents, copies included, to which this
    one is near.  The result is exact, but for collisions of hashes: of 56 bits
    between n-grams, of 64 between sets.  Words are those of textvec.words.

    How: documents with the same bag of n-grams are one set from the start.
    Each set is sent to the regions of its first n-grams (see above), as packed
    columns.  A region's members are compared in order of size, each with the
    next NEAR; sizes, places in the order and the number of common first n-grams
    rule out most pairs, exact similarities decide on the rest: first of each
    set with the one with which it shares most, then of pairs that aren't
    connected by that, a few for each two components before the others.  Pairs
    found join into components; regions with more
    members that don't lie in one component yet are joined again.  The links
    inside each component are counted by ``voronoi.links``.  Nowhere is a pair
    sent for a group's every two members, so groups of thousands of copies cost
    in proportion to their size.

    Defined cases: null, empty and wordless texts are near to none, not even to
    each other; a text of fewer than n words has one n-gram of all of them, so it
    is near only to its copies; repeated rows are copies of each other; null
    doc_ids are listed as null, a group of nothing else has a null group_id;
    very long texts are read whole; ties in the order of n-grams are broken by
    their hash; other columns are ignored; an empty table gives no rows.
    """
    rows = reliable(grouped(docs, t, n))
    groups = rows.groupBy("label").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n_docs")).where("n_docs > 1")
    sets = rows.groupBy("set_id").agg((F.count("*") - 1).alias("copies"))
    linked = reliable(voronoi.links(reliable(component_members(rows, docs, n)), t))
    out = rows.join(groups, "label").join(sets, "set_id").join(linked, "set_id", "left")
    return out.select("group_id", "doc_id", "n_docs", (F.col("copies") + F.coalesce("links", F.lit(0))).alias("n_links"))


def keep_one(docs: DataFrame, t: float = THRESHOLD, n: int = SHINGLE) -> DataFrame:
    """``docs`` without all but one document of each group: the smallest doc_id stays, nulls last, then the smallest hash of the text.

    All columns stay.  Of rows that are equal in doc_id and text one stays.
    Documents without words all stay.  Texts aren't shuffled while the list of
    documents to drop may be broadcast.
    """
    rows = grouped(docs, t, n)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    one = rows.groupBy("label").agg(best.alias("best"), F.count("*").alias("n_docs")).where("n_docs > 1")
    ident = rows.join(one, "label").groupBy("doc_id", "key").agg(F.count("*").alias("times"), F.first(F.struct(F.col("best.doc_id").alias("d"), F.col("best.key").alias("k"))).alias("best"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.d")) & (F.col("key") == F.col("best.k"))
    ident = reliable(ident.select(F.col("doc_id").alias("drop_id"), F.col("key").alias("drop_key"), (F.col("times") > 1).alias("several"), stays.alias("stays")))
    drop = ident.where("several OR NOT stays")
    match = lambda d: docs["doc_id"].eqNullSafe(d["drop_id"]) & (F.xxhash64(docs["text"]) == d["drop_key"])
    kept = docs.join(if_small(drop), match(drop), "left_anti")
    twice = ident.where("several AND stays")
    again = docs.join(if_small(twice), match(twice), "left_semi")
    again = again.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(again)


LOWER = {c: c + 32 for c in range(65, 91)}
ALONE = "\u3041-\u9fff\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\uf900-\ufaff"
MARKS = "\u00a0\u2000-\u206f\u3000-\u3020\uff01-\uff0f\uff1a-\uff20\ufeff"
WORD = re.compile(f"[{ALONE}]|(?:(?![{ALONE}{MARKS}])[a-z0-9\u0080-\U0010ffff])+")


def brute_force(texts: list[str | None], t: float = THRESHOLD, n: int = SHINGLE) -> tuple[list[int | None], list[int]]:
    """For tests: the index of the first document of each one's group, None for those without words, and each one's number of links; every pair is compared."""
    sets = []
    for s in texts:
        w = WORD.findall((s or "").translate(LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent, links = list(range(len(texts))), [0] * len(texts)

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and len(x & sets[j]) >= t * len(x | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                if root(i) != root(j):
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) if s else None for i, s in enumerate(sets)], links
