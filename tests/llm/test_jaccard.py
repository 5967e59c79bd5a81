import random
from collections import defaultdict

import numpy as np
from cases import none, odd, odd_rows

from docloom.llm import jaccard


def expected(rows):
    groups = defaultdict(list)
    for (doc_id, _), g in zip(rows, jaccard.brute_force([t for _, t in rows])[0], strict=True):
        if g is not None:
            groups[g].append(doc_id)
    return [v for v in groups.values() if len(v) > 1]


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = defaultdict(list)
    rows_of = jaccard.near_duplicates(df, **how).collect()
    for r in rows_of:
        got[r.group_id].append(r.doc_id)
    want = {min(v): sorted(v) for v in expected(rows)}
    assert {k: sorted(v) for k, v in got.items()} == want
    links = jaccard.brute_force([t for _, t in rows])[1]
    assert {r.doc_id: r.n_links for r in rows_of} == {i: n for (i, _), n in zip(rows, links, strict=True) if n}
    return want


def words(rng, n):
    return [rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("klmnpqrst") + rng.choice("aeiou") for _ in range(n)]


def corpus(seed):
    """Families of edited copies, passages that many share, and short texts."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    rows = []
    for family in range(12):
        base = words(rng, rng.randint(5, 150))
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 6)):
                w[rng.randrange(len(w))] = rng.choice(words(rng, 3))
            if family % 3 == 0:
                w += passage
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return rows


def test_as_brute_force(spark):
    assert len(check(spark, corpus(1))) >= 3


def test_regions_are_joined_again(spark):
    """With one neighbour compared at first, the second round has to find the rest."""
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = defaultdict(set)
    for r in jaccard.grouped(df, near=1).collect():
        got[r.label].add(r.doc_id)
    assert sorted(map(sorted, (v for v in got.values() if len(v) > 1))) == sorted(map(sorted, expected(rows)))


def test_connected_pairs_are_not_verified(spark, monkeypatch):
    """In large families fewer pairs are verified in rounds than at once, and the groups stay the same."""
    rng, rows = random.Random(5), []
    for _ in range(3):
        base = words(rng, 80)
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randint(3, 9)):
                w[rng.randrange(len(w))] = rng.choice(words(rng, 3))
            rows.append((len(rows), " ".join(w)))
    sent, similar = [], jaccard.similar

    def counted(pairs, *rest):
        sent.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(jaccard, "similar", counted)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = []
    for how in ({"one_round": 0}, {"one_round": 1 << 40}):
        groups = defaultdict(set)
        for r in jaccard.grouped(df, **how).collect():
            groups[r.label].add(r.doc_id)
        got.append((sum(sent), sorted(map(sorted, (v for v in groups.values() if len(v) > 1)))))
        sent.clear()
    assert got[0][1] == got[1][1] == sorted(map(sorted, expected(rows)))
    assert got[0][0] < 0.7 * got[1][0]


def test_whole_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    check(spark, rows)


def test_bounds_lose_nothing():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        common = rng.integers(0, 2**63, n).astype(np.uint64)
        a = np.unique(np.concatenate([common, rng.integers(0, 2**63, int(rng.integers(0, 300))).astype(np.uint64)]))
        b = np.unique(np.concatenate([common, rng.integers(0, 2**63, int(rng.integers(0, 300))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        j = both / (len(a) + len(b) - both)
        for t in (0.3, 0.5, 0.8):
            assert (j >= t) == (both >= jaccard.overlap_needed(np.array(len(a)), np.array(len(b)), t))


def test_cases(spark):
    got = [(r.doc_id is None, r.doc_id, r.n_docs) for r in jaccard.near_duplicates(odd(spark)).collect() if r.group_id is not None]
    # PROSE three times: rows 4 (thrice), 5 and one without an id; with 2000 times it shares nearly all n-grams.
    assert sorted(map(repr, got)) == sorted(map(repr, [(False, 4, 6)] * 3 + [(False, 5, 6), (False, 7, 6), (True, None, 6)]))
    assert jaccard.near_duplicates(none(spark)).count() == 0


def test_one_stays(spark):
    kept = jaccard.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == sorted([0, 1, 2, 3, 4, 6, 8, 9, None], key=repr)
    assert len(odd_rows()) == 14
    assert jaccard.keep_one(none(spark)).count() == 0


def test_chains_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 101), (7, 7)], "a bigint, b bigint")
    got = {r.set_id: r.label for r in jaccard.components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (99, 100, 101)} == {99}
