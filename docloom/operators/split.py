"""Splitters: rows of text in, ordered units out.

A splitter takes (doc_id, seq, content, context_path) units and gives such
units; documents are units with seq 0.  Splitters chain with
``DataFrame.transform``; seq is renumbered after each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidInput
from ..functions.text import PIPE_TABLE, html_tables
from ..workers import importable

COLUMNS = ("doc_id", "seq", "content", "context_path")
Counter = Callable[[str], int]


def words(text: str) -> int:
    """The tokenizer used unless another is given: number of words."""
    return len(text.split())


def as_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.lit(0).alias("seq"), F.col(text).alias("content"), F.lit(None).cast("string").alias("context_path"))


def chain(units: DataFrame, name: str = "") -> DataFrame:
    """Adds unit_id, prev_unit_id and next_unit_id; ids follow from document, splitter, place and content, so a repeated run gives the same."""
    uid = F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(name), F.col("seq").cast("string"), F.coalesce("content", F.lit(""))), 256)
    w = Window.partitionBy("doc_id").orderBy("seq")
    return units.withColumn("unit_id", F.substring(uid, 1, 32)).withColumns({"prev_unit_id": F.lag("unit_id").over(w), "next_unit_id": F.lead("unit_id").over(w)})


def renumber(units: DataFrame, sub: str = "sub") -> DataFrame:
    return units.withColumn("seq", (F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", sub)) - 1).cast("int")).drop(sub)


def split_sentences(units: DataFrame) -> DataFrame:
    """Sentences end at white space after . ! ? or the ideographic full stop; blank ones go."""
    each = units.select("doc_id", "seq", F.posexplode(F.split("content", r"(?<=[.!?。])\s+")).alias("sub", "content"), "context_path")
    return renumber(each.where("trim(content) != ''"))


def chunk_tokens(units: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Windows of ``size`` words, each starting ``size - overlap`` after the one before; the first that reaches the end is the last."""
    if not 0 <= overlap < size:
        raise InvalidInput("0 <= overlap < size")
    w = units.withColumn("w", F.filter(F.split(F.coalesce("content", F.lit("")), r"[ \t\r\n]+"), lambda x: x != "")).where("size(w) > 0")
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / F.lit(float(size - overlap)))).cast("int")
    each = w.withColumn("sub", F.explode(F.sequence(F.lit(0), last)))
    return renumber(each.select("doc_id", "seq", "sub", F.array_join(F.slice("w", F.col("sub") * (size - overlap) + 1, size), " ").alias("content"), "context_path"))


HEADER = re.compile(r"(#+)[ \t](.*)$")


def split_headers(units: DataFrame, sep: str = " > ", include_header: bool = True) -> DataFrame:
    """Sections of Markdown: from a heading to the next, with the path of headings above.

    Lines between fences of three backticks are no headings.  Text before the
    first heading has a null path; empty sections go, so a heading without text
    stays only if headings are included.  A document is worked through by
    itself, line by line, in Arrow batches; nothing is shuffled but to number
    the sections.
    """
    importable(units.sparkSession)

    @F.pandas_udf("array<struct<content:string,context_path:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else sections(t, sep, include_header))

    each = units.select("doc_id", "seq", F.posexplode(cut("content")).alias("sub", "s"))
    return renumber(each.select("doc_id", "seq", "sub", "s.content", "s.context_path"))


BLANKS = " \t\n\x0b\f\r"


def sections(text: str, sep: str = " > ", include_header: bool = True) -> list[tuple[str, str | None]]:
    """(content, path) of each section of a Markdown text that isn't empty."""
    out: list[tuple[str, str | None]] = []
    stack: list[tuple[int, str]] = []
    lines: list[str] = []
    path: str | None = None
    fenced = False

    def close() -> None:
        content = "\n".join(lines).strip(BLANKS)
        if content:
            out.append((content, path))
        lines.clear()

    for line in text.split("\n"):
        fence = line.lstrip(" ").startswith("```")
        fenced ^= fence
        m = None if fence or fenced else HEADER.match(line)
        if m is None:
            lines.append(line)
            continue
        close()
        level, title = len(m.group(1)), m.group(2).strip(" ")
        stack = [h for h in stack if h[0] < level] + [(level, title)]
        path = sep.join(t for _, t in stack)
        if include_header:
            lines.append(f"{'#' * level} {title}")
    close()
    return out


def greedy(counts: Iterable[int], most: int) -> list[int]:
    """Group of each piece: a new one starts when the piece doesn't fit the sum any more."""
    out, group, used, some = [], 0, 0, False
    for c in counts:
        if some and used + c > most:
            group, used = group + 1, 0
        used, some = used + c, True
        out.append(group)
    return out


def pack(pieces: list[str], most: int, count: Counter, joiner: str) -> list[str]:
    groups: dict[int, list[str]] = {}
    for g, p in zip(greedy([count(p) for p in pieces], most), pieces, strict=True):
        groups.setdefault(g, []).append(p)
    return [joiner.join(g) for g in groups.values()]


def hard_cut(text: str, most: int) -> list[str]:
    w = text.split()
    return [" ".join(w[i : i + most]) for i in range(0, len(w), most)]


def pack_sentences(text: str, most: int, count: Counter) -> list[str]:
    out: list[str] = []
    run: list[str] = []
    for s in re.split(r"(?<=[.!?。])\s+", text):
        if count(s) > most:
            out += pack(run, most, count, " ") + hard_cut(s, most)
            run = []
        elif s.strip():
            run.append(s)
    return out + pack(run, most, count, " ")


def pack_paragraphs(text: str, most: int, count: Counter) -> list[str]:
    """Paragraphs packed in order up to ``most`` tokens, the joiners uncounted; one over the limit is packed by its sentences."""
    out: list[str] = []
    run: list[str] = []
    for p in text.split("\n\n"):
        if not p.strip():
            continue
        if count(p) > most:
            out += pack(run, most, count, "\n\n") + pack_sentences(p, most, count)
            run = []
        else:
            run.append(p)
    return out + pack(run, most, count, "\n\n")


def table_spans(text: str) -> list[tuple[int, int]]:
    """Places of pipe and HTML tables in order; one that overlaps an earlier one is part of it."""
    found = sorted([m.span() for m in re.finditer(PIPE_TABLE, text)] + html_tables(text))
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def segments(text: str) -> list[tuple[bool, str]]:
    """(is a table, text) in order; blank text between tables goes."""
    out, at = [], 0
    for a, b in [*table_spans(text), (len(text), len(text))]:
        if text[at:a].strip():
            out.append((False, text[at:a]))
        if b > a:
            out.append((True, text[a:b]))
        at = b
    return out


def split_text(text: str, most: int = 1200, count: Counter = words) -> list[str]:
    """A text within the limit stays; else each table is a unit of its own, whole, and the text between them is packed by paragraphs."""
    if not text.strip():
        return []
    if count(text) <= most:
        return [text]
    out: list[str] = []
    run: list[str] = []  # the paragraphs that are packed next

    def flush() -> None:
        out.extend(pack(run, most, count, "\n\n"))
        run.clear()

    for table, part in segments(text):
        if table:
            flush()
            out.append(part.strip("\n"))
        else:
            for p in part.split("\n\n"):
                if p.strip() and count(p) > most:
                    flush()
                    out.extend(pack_sentences(p.strip(), most, count))
                elif p.strip():
                    run.append(p.strip("\n"))
    flush()
    return out


def split_pipe_table(table: str, most: int, count: Counter, least_rows: int = 1) -> list[str]:
    """Rows packed under a repeated head; fewer than ``least_rows`` rows stay together even over the limit."""
    lines = [x for x in table.strip("\n").split("\n") if x.strip()]
    if len(lines) < 3 or count(table) <= most:
        return [table]
    head, rows = lines[:2], lines[2:]
    out: list[list[str]] = []
    used = base = sum(map(count, head))
    run: list[str] = []
    for r in rows:
        if len(run) >= least_rows and used + count(r) > most:
            out.append(run)
            run, used = [], base
        run.append(r)
        used += count(r)
    return ["\n".join([*head, *r]) for r in [*out, run] if r]


def split_html_table(table: str, most: int, count: Counter, least_rows: int = 1) -> list[str]:
    """The same for an HTML table: its opening tag and head are repeated."""
    if count(table) <= most:
        return [table]
    opening = re.match(r"(?is)<table\b[^>]*>", table)
    rows = re.findall(r"(?is)<tr\b.*?</tr>", table)
    head = re.search(r"(?is)<thead\b.*?</thead>", table)
    top = re.findall(r"(?is)<tr\b.*?</tr>", head.group()) if head else rows[:1]
    rows = rows[len(top) :]
    if not opening or not rows:
        return [table]
    first = f"<thead>{''.join(top)}</thead>"
    base = count(first)
    groups: list[list[str]] = []
    run: list[str] = []
    used = base
    for r in rows:
        if len(run) >= least_rows and used + count(r) > most:
            groups.append(run)
            run, used = [], base
        run.append(r)
        used += count(r)
    return [f"{opening.group()}{first}<tbody>{''.join(g)}</tbody></table>" for g in [*groups, run] if g]


def split_tables(text: str, most: int = 1500, count: Counter = words, least_rows: int = 1) -> list[str]:
    """Tables over the limit are split by rows; text stays."""
    parts = segments(text)
    if not any(t for t, _ in parts):
        return [text] if text.strip() else []
    out: list[str] = []
    for table, part in parts:
        if not table:
            out.append(part.strip())
        elif part.lstrip().lower().startswith("<table"):
            out += split_html_table(part.strip(), most, count, least_rows)
        else:
            out += split_pipe_table(part, most, count, least_rows)
    return out


def by_row(units: DataFrame, function: Callable[[str], list[str]]) -> DataFrame:
    """Applies a text -> pieces function to every unit in Arrow batches; null texts give none."""
    importable(units.sparkSession)

    @F.pandas_udf("array<string>")
    def cut(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in text:
            yield s.map(lambda t: [] if t is None else function(t))

    each = units.select("doc_id", "seq", F.posexplode(cut("content")).alias("sub", "content"), "context_path")
    return renumber(each)


def text_splitter(most: int = 1200, count: Counter = words) -> Callable[[DataFrame], DataFrame]:
    return lambda units: by_row(units, lambda t: split_text(t, most, count))


def paragraph_splitter(most: int = 1200, count: Counter = words) -> Callable[[DataFrame], DataFrame]:
    return lambda units: by_row(units, lambda t: pack_paragraphs(t, most, count))


def table_splitter(most: int = 1500, least_rows: int = 1, count: Counter = words) -> Callable[[DataFrame], DataFrame]:
    if most < 100:
        raise InvalidInput("most must be at least 100")
    return lambda units: by_row(units, lambda t: split_tables(t, most, count, least_rows))


def merge_small(units: DataFrame, target: int = 500, tokens: Column | None = None, joiner: str = "\n\n") -> DataFrame:
    """Neighbours merged in order while their sum of tokens is at most ``target``; the first's path counts, and units of no kind are left out."""
    from ..functions.text import word_count

    importable(units.sparkSession)
    sized = units.withColumn("_n", tokens if tokens is not None else word_count(F.col("content")))
    grouped = sized.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "content", "context_path", "_n"))).alias("u"))

    @F.pandas_udf("array<int>")
    def groups(counts: pd.Series) -> pd.Series:
        return counts.map(lambda c: greedy([int(x) for x in c], target))

    g = grouped.withColumn("g", groups(F.transform("u", lambda x: x["_n"])))
    each = g.select("doc_id", F.explode(F.arrays_zip("u", "g")).alias("z")).select("doc_id", F.col("z.g").alias("seq"), F.col("z.u").alias("u"))
    first = F.min_by("u.context_path", "u.seq")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("u.seq", "u.content"))), lambda x: x["content"]), joiner)
    return each.groupBy("doc_id", "seq").agg(text.alias("content"), first.alias("context_path"))
