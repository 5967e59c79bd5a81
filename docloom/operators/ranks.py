"""The first of many candidates, as Spark orders them, in Arrow functions that keep little."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def codes(values: pa.Array) -> np.ndarray:
    """Numbers in the order that Spark gives the values: null first, NaN last.  Where Arrow can't order a type all are 0, and ties stay open."""
    try:
        found = pc.rank(values.cast(pa.int8()) if pa.types.is_boolean(values.type) else values, sort_keys="ascending", null_placement="at_start", tiebreaker="dense")
    except (pa.ArrowNotImplementedError, pa.ArrowInvalid, pa.ArrowTypeError):
        return np.zeros(len(values), np.int64)
    out = found.to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_floating(values.type):
        out[pc.fill_null(pc.is_nan(values), False).to_numpy(zero_copy_only=False)] = len(values) + 1
    return out


def leading(row: np.ndarray, key: np.ndarray, code: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k first by key, the largest first, then code; and of what is equal to the last in both."""
    order = np.lexsort((code, -key, row))
    if not len(order):
        return order
    r, x, c = row[order], key[order], code[order]
    start = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    size = np.diff(np.concatenate([start, [len(r)]]))
    last = np.repeat(start + np.minimum(k, size) - 1, size)
    return order[(x > x[last]) | ((x == x[last]) & (c <= c[last]))]
