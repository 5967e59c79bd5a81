"""Mongo-style filters compiled to columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidInput

ALIASES = ("metadata.custom.", "metadata.")
Field = tuple[Column, T.DataType | None]


def _in_struct(kind: T.DataType, column: Column, names: Sequence[str]) -> Field | None:
    for k, name in enumerate(names):
        if isinstance(kind, T.StructType) and name in kind.fieldNames():
            column, kind = column.getField(name), kind[name].dataType
        elif isinstance(kind, T.MapType):
            column, kind = F.try_element_at(column, F.lit(".".join(names[k:]))), kind.valueType
            break
        elif isinstance(kind, (T.StringType, T.VariantType)):
            doc = F.try_parse_json(column) if isinstance(kind, T.StringType) else column
            return F.try_variant_get(doc, "$" + "".join(f".{n}" for n in names[k:]), "string"), None
        else:
            return None
    return column, kind


def resolve(df: DataFrame, path: str) -> Field:
    """The column a dotted path means: a column, a field of a struct, a key of a map, or a path in JSON text or a variant.

    Leading ``metadata.custom.`` and ``metadata.`` may be left in where the table has no such column.
    """
    tries = [path, *(path[len(a) :] for a in ALIASES if path.startswith(a))]
    for p in tries:
        names = p.split(".")
        for cut in range(len(names), 0, -1):
            head = ".".join(names[:cut])
            if head in df.columns:
                found = _in_struct(df.schema[head].dataType, df[f"`{head}`"], names[cut:])
                if found:
                    return found
    raise InvalidInput(f"no field {path!r}")


def _literal(field: Field, value) -> tuple[Column, Column]:
    """Field and value of one type; a value of another kind than the field compares as null."""
    column, kind = field
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind is None:  # dynamic: typed by the value
        if number:
            return column.try_cast("double"), F.lit(float(value))
        return (column.try_cast("boolean"), F.lit(value)) if isinstance(value, bool) else (column, F.lit(value))
    if isinstance(kind, T.NumericType) != number or isinstance(kind, T.BooleanType) != isinstance(value, bool):
        if not (isinstance(kind, (T.DateType, T.TimestampType)) and not number):
            return F.lit(None).cast("string"), F.lit(None).cast("string")
    return column, F.lit(value)


def _sure(c: Column, strict: bool) -> Column:
    """Null made false where it matters: in a filter's positive parts a bare comparison can be pushed into the scan."""
    return F.coalesce(c, F.lit(False)) if strict else c


def _equals(field: Field, value, strict: bool) -> Column:
    column, kind = field
    if value is None:
        return column.isNull()
    if isinstance(kind, T.ArrayType):
        return _sure(F.array_contains(column, F.lit(value).cast(kind.elementType)), strict)
    a, b = _literal(field, value)
    return _sure(a == b, strict)


def _one(field: Field, op: str, value, strict: bool) -> Column:
    if op == "$eq":
        return _equals(field, value, strict)
    if op == "$ne":
        return ~_equals(field, value, True)
    if op in ("$in", "$nin"):
        values = list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]
        found = reduce(lambda a, b: a | b, [_equals(field, v, strict or op == "$nin") for v in values], F.lit(False))
        return found if op == "$in" else ~found
    if op in ("$gt", "$gte", "$lt", "$lte"):
        a, b = _literal(field, value)
        return _sure({"$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}[op], strict)
    if op == "$not":
        return ~_field(field, value, True)
    raise InvalidInput(f"unknown operator {op!r}")


def _field(field: Field, condition, strict: bool) -> Column:
    if isinstance(condition, Mapping):
        return reduce(lambda a, b: a & b, [_one(field, op, v, strict) for op, v in condition.items()], F.lit(True))
    return _equals(field, condition, strict)


def _compile(df: DataFrame, condition: Mapping | str | Column | None, strict: bool) -> Column:
    if condition is None:
        return F.lit(True)
    if isinstance(condition, Column):
        return _sure(condition, strict)
    if isinstance(condition, str):
        return _sure(F.expr(condition), strict)
    parts = []
    for key, value in condition.items():
        if key in ("$and", "$or", "$nor"):
            each = [_compile(df, c, strict or key == "$nor") for c in value]
            joined = reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), each, F.lit(key == "$and"))
            parts.append(~joined if key == "$nor" else joined)
        elif key == "$not":
            parts.append(~_compile(df, value, True))
        elif key.startswith("$"):
            raise InvalidInput(f"unknown operator {key!r}")
        else:
            parts.append(_field(resolve(df, key), value, strict))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def compile_filter(df: DataFrame, condition: Mapping | str | Column | None) -> Column:
    """A boolean column, never null.

    Keys are ANDed, as are the operators of one field: $eq $ne $gt $gte $lt
    $lte $in $nin $not, and $and $or $not $nor over conditions.  A missing field
    is unequal to everything but None; comparisons between kinds are false;
    empty $in and $or are false, empty $nin and $and true; on an array a value
    means that it is contained.  Text is taken as a SQL expression.  Unknown
    operators and fields raise.
    """
    return _compile(df, condition, True)


def where(df: DataFrame, condition: Mapping | str | Column | None) -> DataFrame:
    """The rows for which the filter is true; its positive comparisons can be pushed into the scan."""
    return df if condition is None else df.where(_compile(df, condition, False))
