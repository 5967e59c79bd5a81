import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.errors import InvalidInput
from docloom.operators.filters import compile_filter, where

ROWS = [
    (1, "a", 1.5, True, ["x", "y"], ("p", 3), '{"k": 5, "deep": {"s": "t"}}', datetime.datetime(2024, 1, 1)),
    (2, "b", None, False, [], ("q", None), '{"k": "five"}', None),
    (3, None, -2.0, None, None, None, None, datetime.datetime(2025, 1, 1)),
    (4, "a", 9.0, True, ["y"], ("p", 7), "not json", datetime.datetime(2026, 1, 1)),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id long, s string, d double, b boolean, tags array<string>, m struct<name: string, n: int>, props string, ts timestamp").cache()


@pytest.mark.parametrize(
    ("condition", "ids"),
    [
        (None, {1, 2, 3, 4}),
        ({}, {1, 2, 3, 4}),
        ({"s": "a"}, {1, 4}),
        ({"s": None}, {3}),
        ({"s": {"$ne": "a"}}, {2, 3}),
        ({"s": {"$nin": ["a", "b"]}}, {3}),
        ({"s": {"$nin": []}}, {1, 2, 3, 4}),
        ({"s": {"$in": []}}, set()),
        ({"s": {"$in": "a"}}, {1, 4}),
        ({"d": {"$gt": 0, "$lt": 5}}, {1}),
        ({"d": {"$gt": "zero"}}, set()),
        ({"s": {"$not": {"$eq": "a"}}}, {2, 3}),
        ({"$not": {"d": {"$gte": 1.5}}}, {2, 3}),
        ({"$or": [{"id": 2}, {"d": {"$lte": -2}}]}, {2, 3}),
        ({"$or": []}, set()),
        ({"$and": []}, {1, 2, 3, 4}),
        ({"$nor": [{"id": 1}, {"id": 2}]}, {3, 4}),
        ({"tags": "y"}, {1, 4}),
        ({"tags": {"$in": ["x"]}}, {1}),
        ({"m.n": {"$gte": 3}}, {1, 4}),
        ({"metadata.custom.m.name": "q"}, {2}),
        ({"props.k": {"$gte": 5}}, {1}),
        ({"props.deep.s": "t"}, {1}),
        ({"b": True}, {1, 4}),
        ({"b": 1}, set()),
        ({"ts": {"$gte": datetime.datetime(2025, 1, 1)}}, {3, 4}),
        ("d > 1 AND s = 'a'", {1, 4}),
    ],
)
def test_conditions(df, condition, ids):
    assert {r.id for r in where(df, condition).collect()} == ids


@pytest.mark.parametrize("condition", [{"nothing": 1}, {"s": {"$like": "a"}}, {"$xor": []}])
def test_unknown_names_raise(df, condition):
    with pytest.raises(InvalidInput):
        compile_filter(df, condition)


conditions = st.recursive(
    st.one_of(
        st.builds(lambda v: {"s": v}, st.sampled_from(["a", "b", None])),
        st.builds(lambda op, v: {"d": {op: v}}, st.sampled_from(["$gt", "$gte", "$lt", "$lte", "$eq", "$ne"]), st.sampled_from([-2.0, 0, 1.5, 9])),
        st.builds(lambda op, v: {"s": {op: v}}, st.sampled_from(["$in", "$nin"]), st.lists(st.sampled_from(["a", "b"]), max_size=2)),
    ),
    lambda c: st.one_of(st.builds(lambda op, x: {op: x}, st.sampled_from(["$and", "$or", "$nor"]), st.lists(c, max_size=3)), st.builds(lambda x: {"$not": x}, c)),
    max_leaves=5,
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(conditions)
def test_a_filter_and_its_negation_part_the_rows(df, condition):
    c = compile_filter(df, condition)
    n = compile_filter(df, {"$not": condition})
    got = df.select(c.alias("c"), n.alias("n")).collect()
    assert all(r.c is not None and r.c != r.n for r in got)


def test_filters_reach_the_scan(spark, data):
    plan = where(spark.read.parquet(f"{data}/orders.parquet"), {"o_totalprice": {"$gte": 1000}}).select(F.col("o_orderkey"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,1000.0)" in plan
    assert "o_orderdate" not in plan
