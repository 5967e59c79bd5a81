"""Exact counting of near pairs inside groups, as a recursive join of Voronoi regions in Jaccard's metric space.

A cell is a group of sets that may be near each other: residents, among which
all pairs count, and guests, which count with residents only.  A cell whose
residents are too many for a task is divided: some residents become pivots,
every resident moves to the region of its nearest pivot, and what lies in the
triangle window of a later region, that is no farther from its pivot than that
region's radius and the distance asked for together, is copied there as a guest.
Pairs of different regions are so met once, in the later one.  Regions are cells
again and are divided on until they are small.

The triangle inequality also works from above: a guest whose distance to a pivot
and the region's radius together are within the distance asked for is near to
all residents, and a region of half that radius is near throughout.  Such pairs
are counted by sums, without being looked at, so that a family of a million
near copies costs as much as its members, not as its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import map_arrow
from .common import if_light, reliable, settled

#: Bytes of residents up to which a cell is compared in one task; guests pass by.
CELL_BYTES = 2 << 20
PIVOTS = 16
#: A bound on sums of distances is only trusted beyond rounding.
SURE = 1e-9

MEMBERS = "cell bigint, set_id bigint, weight bigint, guest boolean, open boolean, grams binary"
NAMES = ("cell", "set_id", "weight", "guest", "open", "grams")
_U = np.uint64


class Residents:
    """The sets of a cell, ready to be compared with one at a time."""

    def __init__(self, ids: list[int], weights: list[int], sets: list[np.ndarray]):
        self.ids, self.weights = ids, np.array(weights, np.int64)
        self.sizes = np.array([len(s) for s in sets])
        self.sets = sets
        self.grams, self.inverse = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.links = np.zeros(len(ids), np.int64)

    def near(self, one: np.ndarray, t: float) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.grams, one), len(self.grams) - 1)
        mark = np.zeros(len(self.grams), np.int32)
        mark[place[self.grams[place] == one]] = 1
        both = np.add.reduceat(mark[self.inverse], self.starts)
        return both >= t * (self.sizes + len(one) - both) - 1e-9

    def among(self, t: float) -> None:
        for i, s in enumerate(self.sets):
            near = self.near(s, t)
            near[i] = False
            self.links[i] += self.weights[near].sum()

    def guest(self, one: np.ndarray, weight: int, t: float) -> int:
        near = self.near(one, t)
        self.links[near] += weight
        return int(self.weights[near].sum())


def compared(members: DataFrame, t: float) -> DataFrame:
    """(set_id, links) of small cells: residents are held, guests stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fresh = None, False
        held: tuple[list, list, list] = ([], [], [])
        now: Residents | None = None
        out: tuple[list[int], list[int]] = ([], [])

        def settle() -> None:
            """All residents of a cell are there."""
            nonlocal now
            if now is None and held[0]:
                now = Residents(*held)
                if fresh:
                    now.among(t)

        def leave() -> None:
            nonlocal now, held
            settle()
            if now is not None:
                out[0].extend(now.ids), out[1].extend(now.links.tolist())
            now, held = None, ([], [], [])

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["set_id", "links"])
            out[0].clear(), out[1].clear()
            return batch

        for batch in batches:
            for c, i, w, guest, open_, grams in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5), strict=True):
                if c != cell:
                    leave()
                    cell, fresh = c, open_
                one = np.frombuffer(grams.as_py(), _U)
                if not guest:
                    held[0].append(i), held[1].append(w), held[2].append(one)
                else:
                    settle()
                    if now is not None:
                        out[0].append(i), out[1].append(now.guest(one, w, t))
            if len(out[0]) > 10000:
                yield rows()
        leave()
        yield rows()

    return map_arrow(members.repartition("cell").sortWithinPartitions("cell", "guest"), run, "set_id bigint, links bigint")


def distances(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """``members`` and their distances d to their cell's pivots; pivots: (cell, pivots: array<binary>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for grams, them in zip(batch.column(5), batch.column(6), strict=True):
                x, d = np.frombuffer(grams.as_py(), _U), []
                for p in them:
                    y = np.frombuffer(p.as_py(), _U)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    d.append(1 - both / (len(x) + len(y) - both))
                rows.append(d)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(rows, pa.list_(pa.float64()))], [*NAMES, "d"])

    joined = members.join(if_light(pivots, F.aggregate("pivots", F.lit(16), lambda a, p: a + F.length(p))), "cell")
    return map_arrow(joined.select(*NAMES, "pivots"), run, MEMBERS + ", d array<double>")


def divided(members: DataFrame, t: float, level: int, k: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(members of the regions, (set_id, links) that follow from the triangle inequality alone)."""
    r = 1 - t
    salt = F.xxhash64("set_id", F.lit(level))
    # One pivot for each of k classes of a hash: partial minima, no cell is gathered.
    chosen = members.where("NOT guest").groupBy("cell", F.pmod(salt, F.lit(k)).alias("class")).agg(F.min_by("grams", salt).alias("pivot"))
    pivots = chosen.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "pivot"))), lambda x: x["pivot"]).alias("pivots"))  # at most k of a cell
    far = distances(members, reliable(pivots))
    # What is as far from several pivots, as unrelated sets are from all, is spread over them.
    ties = F.filter(F.transform("d", lambda x, i: F.when(x == F.array_min("d"), i + 1)), lambda i: i.isNotNull())
    home = F.element_at(ties, (F.pmod(F.xxhash64("set_id", F.lit(-level)), F.size(ties)) + 1).cast("int")).cast("int")
    far = reliable(far.withColumn("home", F.when(~F.col("guest"), home)))
    # A region with more than half of its cell is cut by a hash into k with the same pivot.
    share = far.where("NOT guest").groupBy("cell", "home").agg(F.count("*").alias("n"))
    crowded = share.groupBy("cell").agg(F.max_by("home", "n").alias("hub"), F.max("n").alias("most"), F.sum("n").alias("all")).where("most * 2 > all").select("cell", "hub")
    far = far.join(if_light(reliable(crowded), F.lit(24)), "cell", "left")
    part = F.when(F.col("home") == F.col("hub"), F.pmod(F.xxhash64("set_id", F.lit(~level)), F.lit(k)).cast("int")).otherwise(0)
    far = far.withColumn("slot", F.col("home") * k + part)
    radius = far.where("NOT guest").groupBy("cell", "home", "slot").agg(F.max(F.element_at("d", F.col("home"))).alias("radius"), F.sum("weight").alias("whole"))
    regions = radius.groupBy("cell").agg(F.collect_list(F.struct("home", "slot", "radius", "whole")).alias("regions"))  # fewer than 2 k of a cell
    one = far.join(if_light(reliable(regions), F.size("regions") * 28 + 16), "cell").select(*NAMES, "slot", "d", F.explode("regions").alias("g"))
    one = one.withColumn("to", F.element_at("d", F.col("g.home")))
    at_home = F.coalesce(F.col("slot") == F.col("g.slot"), F.lit(False))
    visits = (F.col("guest") | (F.col("open") & (F.col("g.slot") > F.col("slot")))) & (F.col("to") <= F.col("g.radius") + r + SURE)
    seen = one.where(at_home | visits).select(
        F.xxhash64("cell", "g.slot", F.lit(level)).alias("cell"),
        "set_id",
        "weight",
        (~at_home).alias("guest"),
        (F.col("open") & (2 * F.col("g.radius") > r - SURE)).alias("open"),
        "grams",
        (~at_home & (F.col("to") + F.col("g.radius") <= r - SURE)).alias("near_all"),
        (at_home & F.col("open") & (2 * F.col("g.radius") <= r - SURE)).alias("mutual"),
        F.col("g.whole").alias("whole"),
    )
    seen = settled(seen)
    gift = seen.where("near_all").groupBy("cell").agg(F.sum("weight").alias("links"))
    known = seen.where("near_all").select("set_id", F.col("whole").alias("links"))
    known = known.union(seen.where("NOT guest").select("cell", "set_id").join(if_light(reliable(gift), F.lit(24)), "cell").select("set_id", "links"))
    known = known.union(seen.where("mutual").select("set_id", (F.col("whole") - F.col("weight")).alias("links")))
    rest = seen.where("NOT near_all")
    # A region all of whose pairs are counted stays only for the guests that are left.
    live = rest.where("guest OR open").select("cell").distinct()
    return rest.join(live, "cell", "left_semi").select(*NAMES), known


def links(members: DataFrame, t: float, cell_bytes: int = CELL_BYTES, pivots: int = PIVOTS) -> DataFrame:
    """(set_id, links): the weight of the other sets of its cell that are near to each set, that is with a similarity of at least t; sets without any may be missing.

    ``members`` are as MEMBERS says, materialised, a set once in a cell and its n-grams
    ascending.  Cells are compared when their residents are within
    ``cell_bytes``; larger ones are divided first, again and again.  Sets that are
    as far from all pivots are spread over the regions, so that there are few
    rounds; at worst, where nothing is near, all pairs are compared, in tasks of
    bounded memory.
    """
    parts, level = [], 0
    while True:
        weight = members.where("NOT guest").groupBy("cell").agg(F.sum(F.length("grams")).alias("bytes"), F.count("*").alias("n"))
        large = reliable(weight.where((F.col("bytes") > cell_bytes) & (F.col("n") > pivots)).select("cell"))
        mark = if_light(large, F.lit(16))
        parts.append(reliable(compared(members.join(mark, "cell", "left_anti"), t)))
        if large.isEmpty():
            break
        level += 1
        members, known = divided(settled(members.join(mark, "cell", "left_semi")), t, level, pivots)
        members = settled(members)
        parts.append(reliable(known))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("set_id").agg(F.sum("links").alias("links"))
