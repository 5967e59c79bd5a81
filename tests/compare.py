"""Rows of two engines made comparable."""

import decimal
import math


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        return tuple(map(plain, v))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same(df, relation):
    """Do the DataFrame and DuckDB's result have the same columns and rows?"""
    columns = sorted(df.columns)
    names = [c[0] for c in relation.description]
    assert columns == sorted(names)
    left = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    right = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in relation.fetchall()), key=repr)
    assert len(left) == len(right)
    assert left == right
