import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import voronoi
from docloom.llm.common import reliable


def family(rng, cell, members, edits):
    base = rng.integers(0, 2**63, 80).astype(np.uint64)
    rows = []
    for k in range(members):
        x = base.copy()
        m = int(rng.integers(0, edits))
        x[rng.integers(0, 80, m)] = rng.integers(0, 2**63, m).astype(np.uint64)
        rows.append((cell, cell * 1000 + k, int(rng.integers(1, 4)), False, True, np.unique(x)))
    return rows


def expected(rows, t):
    near = lambda x, y: (b := len(np.intersect1d(x, y))) >= t * (len(x) + len(y) - b) - 1e-9
    return {i: sum(w for c2, j, w, *_, y in rows if j != i and c2 == c and near(x, y)) for c, i, _, *_, x in rows}


@pytest.mark.parametrize("cell_bytes,pivots", [(2 << 20, 16), (20000, 4), (8000, 3)])
def test_links_by_brute_force(spark, cell_bytes, pivots):
    """A wide family, a tight one, which sums decide, and a small one, in one cell and in many regions."""
    rng = np.random.default_rng(1)
    rows = family(rng, 0, 90, 60) + family(rng, 1, 60, 12) + family(rng, 2, 5, 60)
    df = reliable(spark.createDataFrame([(*r[:5], r[5].tobytes()) for r in rows], voronoi.MEMBERS))
    for t in (0.5, 0.8):
        got = {r.set_id: r.links for r in voronoi.links(df, t, cell_bytes, pivots).collect()}
        want = expected(rows, t)
        assert {i: got.get(i, 0) for i in want} == want


def test_a_tight_family_is_counted_by_sums(spark):
    """None of its pairs is compared: the regions' members don't reach the comparison."""
    rng = np.random.default_rng(2)
    rows = family(rng, 0, 80, 5)
    df = reliable(spark.createDataFrame([(*r[:5], r[5].tobytes()) for r in rows], voronoi.MEMBERS))
    rest, known = voronoi.divided(df, 0.5, 1, 4)
    assert rest.isEmpty()
    got = {r.set_id: r.links for r in known.groupBy("set_id").agg(F.sum("links").alias("links")).collect()}
    assert got == expected(rows, 0.5)


def test_no_members(spark):
    assert voronoi.links(spark.createDataFrame([], voronoi.MEMBERS), 0.5).isEmpty()
