"""Scalar text functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A row of cells, a rule of hyphens, colons and pipes, and at least one row more.  Rows are taken possessively: nothing comes after them, and Java would nest a call for each row that it may have to give back.
PIPE_ROW, LINE_END = r"\|.+\|", r"[\r\n]"
PIPE_TABLE = f"({PIPE_ROW}{LINE_END}+\\|[:|\\s-]+\\|{LINE_END}+(?:{PIPE_ROW}{LINE_END}*)++)"
TABLE_TAG = re.compile(r"(?i)<(/?)table\b[^>]*>")


def html_tables(text: str) -> list[tuple[int, int]]:
    """(start, end) of the outermost HTML tables, in order; one that isn't closed is none, what it holds is looked at by itself."""
    found: list[tuple[int, int]] = []
    opened: list[int] = []
    for m in TABLE_TAG.finditer(text):
        if not m.group(1):
            opened.append(m.start())
        elif opened:
            a = opened.pop()
            while found and found[-1][0] > a:  # tables inside
                found.pop()
            found.append((a, m.end()))
    return found


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, where a lambda that names it would do so for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words separated by white space; blank text and null have 0."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("int")


def token_estimate(text: Column, chars_per_token: float = 4.0) -> Column:
    return F.floor(F.length(text) / F.lit(chars_per_token)).cast("bigint")


def terms(text: Column) -> Column:
    """Runs of small ASCII letters and digits of the lowered text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def content_hash(text: Column) -> Column:
    return F.md5(text)


def by_value(function: Callable, kind: str = "string") -> Callable[[str | Column], Column]:
    """A column function, in Arrow batches, from one of a value; null gives null.  Made when called, so that modules load without a session."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else function(v))

    return lambda column: F.pandas_udf(run, kind)(column)


def xxh64_hex(text: str | Column) -> Column:
    """Hexadecimal xxHash64 with seed 0, for ids that other tools made that way."""
    return by_value(lambda t: xxhash.xxh64(t.encode()).hexdigest())(text)


def plain_text(text: str) -> str:
    """Compatibility-normalised text without tags, heading marks and emphasis, white space collapsed."""
    text = re.sub(r"<[^>]+>", "", unicodedata.normalize("NFKC", text))
    text = re.sub(r"(?m)^\s{0,3}#{1,6}\s*", "", text)
    text = re.sub(r"(\*{1,3}|_{1,3})(\S(?:.*?\S)?)\1", r"\2", text)
    return re.sub(r"\s+", " ", text).strip()


def normalize_text(text: str | Column) -> Column:
    return by_value(plain_text)(text)


def clean_page(text: Column) -> Column:
    """Runs of non-breaking-space entities become one blank."""
    return F.regexp_replace(text, "(?:&nbsp;\\s*)+", " ")


def has_pipe_table(text: Column) -> Column:
    return F.coalesce(text.rlike(PIPE_TABLE), F.lit(False))


def has_html_table(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)<table"), F.lit(False))


def looks_tabular(text: Column) -> Column:
    """A table tag, or a line with two pipes and a hyphen somewhere; loose on purpose."""
    line = F.exists(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: (F.length(x) - F.length(F.replace(x, F.lit("|"))) >= 2) & x.contains("-"))
    return has_html_table(text) | line


def path_root(path: Column) -> Column:
    return F.split_part(path, F.lit(" > "), F.lit(1))


def page_label(pages: Column) -> Column:
    """p1, p1-2 for consecutive pages, p1,3,5 for others, N/A for none."""
    p = F.array_sort(F.array_distinct(pages))
    first, last = F.get(p, F.lit(0)), F.get(p, F.size(p) - 1)
    return (
        F.when(pages.isNull() | (F.size(pages) == 0), "N/A")
        .when(F.size(p) == 1, F.concat(F.lit("p"), first.cast("string")))
        .when(last - first + 1 == F.size(p), F.concat(F.lit("p"), first.cast("string"), F.lit("-"), last.cast("string")))
        .otherwise(F.concat(F.lit("p"), F.array_join(F.transform(p, lambda x: x.cast("string")), ",")))
    )


def finite(x: Column) -> Column:
    """Null instead of NaN and infinities, as JSON needs it."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def point_id(unit_id: Column) -> Column:
    """First 8 bytes of SHA-256, big-endian, modulo 2^63."""
    head = F.substring(F.sha2(unit_id, 256), 1, 16)
    top = F.conv(F.substring(head, 1, 8), 16, 10).cast("bigint") % F.lit(1 << 31)
    return top * F.lit(1 << 32) + F.conv(F.substring(head, 9, 8), 16, 10).cast("bigint")
