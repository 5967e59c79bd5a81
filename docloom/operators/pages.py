"""Page numbers of units: from spans, or by finding their text again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_text
from ..workers import map_arrow

SIGNATURE = 50
LEAST = 10


def alike(a: str, b: str, least: float = 0.0) -> float:
    """``difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()``: lengths of runs along all diagonals are worked out once, not for each part.  0 once it can't be ``least`` any more."""
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0 if n == m else 0.0
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    slant = np.zeros((n, n + m), bool)  # row i moved by n - i, by which diagonals are columns
    np.lib.stride_tricks.as_strided(slant[:, n:], (n, m), (slant.strides[0] - 1, 1))[:] = x[:, None] == y[None]
    down = np.arange(n, dtype=np.int32)[:, None]
    runs = down - np.maximum.accumulate(np.where(slant, np.int32(-1), down), axis=0)
    run = np.lib.stride_tricks.as_strided(runs[:, n:], (n, m), (runs.strides[0] - 4, 4))
    total, todo, open_ = 0, [(0, n, 0, m)], min(n, m)
    while todo:
        if 2.0 * (total + open_) / (n + m) < least:
            return 0.0
        i, j, u, v = todo.pop(max(range(len(todo)), key=lambda z: todo[z][1] - todo[z][0]))
        open_ -= min(j - i, v - u)
        part = np.minimum(np.minimum(run[i:j, u:v], np.arange(1, j - i + 1, dtype=np.int32)[:, None]), np.arange(1, v - u + 1, dtype=np.int32))
        at = divmod(int(part.argmax()), v - u)
        if k := int(part[at]):
            total += k
            p, q = at[0] + i - k + 1, at[1] + u - k + 1
            new = [z for z in ((i, p, u, q), (p + k, j, q + k, v)) if z[0] < z[1] and z[2] < z[3]]
            todo += new
            open_ += sum(min(z[1] - z[0], z[3] - z[2]) for z in new)
    return 2.0 * total / (n + m)


def fuzzy_find(needle: str, text: str, start: int = 0, length: int = 300, least: float = 0.7) -> int | None:
    """Where a text's beginning occurs from ``start`` on, or None: exactly by its first characters, else by the window most like it.

    Windows step max(200, half the length); texts are also compared without
    marks and with white space collapsed.
    """
    head = needle.strip()[:length]
    if len(head) < LEAST:
        return None
    at = text.find(head[:SIGNATURE], start)
    if at >= 0 and text.startswith(head, at):
        return at
    if at >= 0 and alike(head, text[at : at + len(head)], least) >= least:
        return at
    plain, step = plain_text(head), max(200, len(head) // 2)
    best, where = 0.0, None
    for a in range(start, max(start + 1, len(text) - len(head) // 2), step):
        window = text[a : a + len(head) + step]
        at = window.find(head[:SIGNATURE])
        piece = window[at : at + len(head)] if at >= 0 else window[: len(head)]
        other = plain_text(piece)
        if other == plain:  # none is more alike, and later ones are no better
            return a + max(at, 0)
        if 2 * min(len(plain), len(other)) >= least * (len(plain) + len(other)) and (r := alike(plain, other, least)) > best:
            best, where = r, a + max(at, 0)
    return where if best >= least else None


def infer(contents: list[str | None], spans: list[tuple[int, int] | None], text: str, pages: list[tuple[int, int, int]]) -> list[list[int] | None]:
    """Page numbers of a document's units in order: a known span decides, else the place found after the unit before, else anywhere, else by 100 characters less strictly."""
    out: list[list[int] | None] = []
    low = 0
    for content, span in zip(contents, spans, strict=True):
        if span is None:
            content = content or ""
            at = fuzzy_find(content, text, low)
            if at is None:
                at = fuzzy_find(content, text, 0)
            if at is None:
                at = fuzzy_find(content, text, 0, 100, 0.6)
            if at is None:
                out.append(None)
                continue
            span = (at, at + len(content))
        low = max(low, span[0])
        out.append([n for n, a, b in pages if a < span[1] and b > span[0]] or None)
    return out


def infer_page_numbers(units: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, seq, page_numbers) of units (doc_id, seq, content, start, end) by documents (doc_id, content, pages with spans); a document with its units is a row."""
    kind = units.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("u", "content", "pages")}
                u = row["u"]
                spans = [None if x["start"] is None or x["end"] is None else (int(x["start"]), int(x["end"])) for x in u]
                found = infer([x["content"] for x in u], spans, row["content"] or "", [(p["number"], p["start"], p["end"]) for p in row["pages"] or []])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([i] * len(u))), pa.array([x["seq"] for x in u], pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "seq", "page_numbers"])

    known = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c)
    each = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "content", known("start"), known("end")))).alias("u"))
    pages = F.transform("pages", lambda p: F.struct(p["page_number"].alias("number"), p["span"]["start"].alias("start"), p["span"]["end"].alias("end")))
    docs = documents.select(F.col("doc_id").alias("_doc"), "content", pages.alias("pages")).dropDuplicates(["_doc"])
    rows = each.join(docs, F.col("doc_id").eqNullSafe(F.col("_doc"))).drop("_doc")
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by bytes, of which there are few, all would be for a few tasks
    return map_arrow(rows.repartition(tasks, "doc_id"), run, f"doc_id {kind}, seq int, page_numbers array<int>")
