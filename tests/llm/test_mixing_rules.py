from collections import Counter, defaultdict

from cases import none, odd, odd_rows

import pytest
from pyspark.sql import functions as F

from docloom.llm import mixing, rules


def test_budgets(spark):
    rows = [(i, "word " * (1 + i % 7), "en", "abc"[i % 3] if i % 10 else None, 0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = mixing.mix_sources(df, {"a": 3.0}, 1.0, 3000).collect()
    words, drawn = Counter(), Counter()
    for i, t, _, s, _ in rows:
        words[s] += len(t.split())
    for r in got:
        drawn[r.source] += r.copies * len(r.text.split())
    for s in words:
        budget = int(3000 * (3 if s == "a" else 1) / 6)
        assert budget - 7 <= drawn[s] <= budget
        assert {r.copies for r in got if r.source == s} <= {budget // words[s], budget // words[s] + 1}
    assert mixing.mixed_documents(df, targets={"a": 3.0}, total_tokens=3000).count() == sum(r.copies for r in got)


def test_better_documents_are_drawn_more_often(spark):
    rows = [(i, "small letters only here" if i % 2 else "LOUD #### !!!! $$$$", "en", "a", 0) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = Counter(r.doc_id % 2 for r in mixing.mix_sources(df, total_tokens=1000).collect())
    assert got[1] > 1.5 * got[0]


def test_documents_without_ids_are_drawn_one_by_one(spark):
    df = spark.createDataFrame([(None, f"word number {i} of many", "en", "a", 0) for i in range(200)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert 95 <= mixing.mix_sources(df, total_tokens=500).count() <= 100


def test_shares(spark):
    df = spark.createDataFrame([(i, "some words here", "en", "b", 0) for i in range(9)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert mixing.mix_sources(df, {"a": 1.0}, 0.0).count() == 0
    for targets, other in (({}, 0.0), ({"a": -1.0}, 1.0), ({"a": float("nan")}, 1.0)):
        with pytest.raises(ValueError):
            mixing.mix_sources(df, targets, other)
    with pytest.raises(ValueError):
        mixing.mix_sources(df, copies="Source")


def test_mixing_cases(spark):
    got = mixing.mix_sources(odd(spark), copies="n_drawn")
    assert got.columns == [*odd(spark).columns, "n_drawn"]
    by = defaultdict(set)
    for r in got.collect():
        by[(r.doc_id, r.text)].add(r.n_drawn)
    assert all(len(v) == 1 for v in by.values())  # repeated rows go together
    assert mixing.mix_sources(none(spark), copies="n_drawn").count() == 0
    assert mixing.mixed_documents(odd(spark)).columns == odd(spark).columns


def test_rules(spark):
    rows = [(i, "plain words of a usual kind. " * 5, "en", "a", 0) for i in range(300)]
    bad = [(1000, "SHOUTING ALL THE TIME " * 9, "en", "a", 0), (1001, "again " * 80, "en", "a", 0), (1002, "#$% &*( " * 30, "en", "a", 0), (1003, "one line\n" * 50, "en", "a", 0)]
    df = spark.createDataFrame(rows + bad, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r.doc_id for r in rules.filter_quality(df).collect()} == set(range(300))
    assert {r.doc_id for r in rules.kept_ids(df).collect()} == set(range(300))


def test_a_faulty_quarter_is_rejected(spark):
    rows = [(i, "plain words of a usual kind. " * 5, "en", "a", 0) for i in range(700)]
    for kind in ("SHOUTING ALL THE TIME " * 9, "again " * 80):
        bad = [(1000 + i, kind, "en", "a", 0) for i in range(300)]
        df = spark.createDataFrame(rows + bad, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        assert {r.doc_id for r in rules.filter_quality(df).collect()} == set(range(700))
        assert {r.doc_id for r in rules.kept_ids(df).collect()} == set(range(700))


def test_limits_differ_where_corpora_differ(spark):
    """Two languages, one of which writes nouns with capitals: each has its own limit, and what is usual in one goes in the other."""
    rows = [(i, ("plain words of a usual kind" if i % 5 else "Plain words of a Usual kind") + " and more" * (i % 7), "en", "a", 0) for i in range(400)]
    rows += [(1000 + i, ("Viele Wörter Haben Große Buchstaben" if i % 3 else "Manche Haben Wenige davon hier") + " und mehr" * (i % 7), "de", "a", 0) for i in range(400)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame(rows, schema)
    lim = {r.r_lang: r.asDict() for r in rules.limits(rules.with_features(df, "r_"), "r_").collect()}
    assert lim["=de"]["r_upper_limit"] > 1.2 * lim["=en"]["r_upper_limit"]
    between = "A" * int(50 * (lim["=de"]["r_upper_limit"] + lim["=en"]["r_upper_limit"]))
    between += "b" * (80 - len(between))
    kept = {r.doc_id for r in rules.filter_quality(spark.createDataFrame([*rows, (5000, between, "en", "a", 0), (5001, between, "de", "a", 0)], schema)).collect()}
    assert 5001 in kept and 5000 not in kept


def test_sketches_merge_and_keep_ranks(spark):
    """Over 20,000 values in parts: the rank of each quantile, of merged parts too, is within 1 %."""
    df = spark.range(20000).selectExpr("'=a' AS r_lang", "concat('=', id % 7) AS r_source", *(f"pmod(hash(id, '{k}'), 100003) / 100003D AS r_{k}" for k in rules.FEATURES)).repartition(9)
    own = rules.sketches(df, "r_")
    merged = own.agg(F.kll_merge_agg_double("r_upper", rules.SKETCH).alias("s")).select(*(F.kll_sketch_get_quantile_double("s", F.lit(q)).alias(f"q{i}") for i, q in enumerate(rules.QUANTILES))).first()
    values = sorted(r.r_upper for r in df.select("r_upper").collect())
    for got, q in zip(merged, rules.QUANTILES, strict=True):
        assert abs(sum(v <= got for v in values) / len(values) - q) < 0.01


def test_rule_cases(spark):
    kept = rules.filter_quality(odd(spark))
    assert kept.columns == odd(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert {0, 1, 2} <= set(ids) and ids.count(4) in (0, 3)
    assert len(ids) <= len(odd_rows())
    assert rules.filter_quality(none(spark)).count() == 0 and rules.kept_ids(none(spark)).count() == 0
