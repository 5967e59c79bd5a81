"""Tables in text: parsing, conversion, repair, merging."""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence
from html import escape
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PIPE_TABLE, by_value, html_tables, let

TABLE = "struct<source_format: string, columns: array<string>, rows: array<array<string>>, is_complex: boolean, start: int, end: int>"


def cells(line: Column) -> Column:
    """Trimmed cells of a pipe row, without what is outside the first and last pipe."""
    parts = F.split(line, r"\|")
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: F.trim(x))


def pipe_tables(text: Column) -> Column:
    """All pipe tables of a text, in order."""
    return F.regexp_extract_all(text, F.lit(PIPE_TABLE), 1)


def parse_pipe(table: Column) -> Column:
    """struct(columns, rows): rows with another number of cells than the head are left out; fewer than three lines give null."""
    lines = F.filter(F.split(table, r"[\r\n]+"), lambda x: F.trim(x) != "")

    def parsed(lines: Column, head: Column) -> Column:
        rows = F.filter(F.transform(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), cells), lambda r: F.size(r) == F.size(head))
        return F.struct(head.alias("columns"), rows.alias("rows"))

    return let(lines, lambda x: F.when(F.size(x) >= 3, let(cells(F.element_at(x, 1)), lambda head: parsed(x, head))))


def to_markdown(columns: Column, rows: Column) -> Column:
    """Pipe table of a head and rows; null cells are empty."""

    def line(r: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(r, lambda x: F.coalesce(x, F.lit(""))), " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.transform(columns, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(columns), rule), F.transform(rows, line)), "\n")


def repair_row(row: Column, width: Column) -> Column:
    """Short rows are filled with empty cells, long ones cut."""
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0)))), F.lit(1), width)


def pipe_to_html(table: Column) -> Column:
    """Rows before the rule become a head, those after it the body; without a rule all is body."""
    lines = F.filter(F.split(table, r"[\r\n]+"), lambda x: F.trim(x) != "")
    rule = F.array_position(F.transform(lines, lambda x: x.rlike(r"^[\s|:\-]+$") & x.contains("-")), True)

    def row(line: Column, tag: str) -> Column:
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(cells(line), lambda c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))

    count = rule.cast("int")
    head = F.array_join(F.transform(F.slice(lines, F.lit(1), F.greatest(count - 1, F.lit(0))), lambda x: row(x, "th")), "")
    body = F.array_join(F.transform(F.slice(lines, count + 1, F.greatest(F.size(lines) - count, F.lit(0))), lambda x: row(x, "td")), "")
    return F.concat(F.lit("<table>"), F.when(count > 1, F.concat(F.lit("<thead>"), head, F.lit("</thead>"))).otherwise(""), F.lit("<tbody>"), body, F.lit("</tbody></table>"))


def is_complex(table: Column) -> Column:
    """Two equal, non-empty neighbours in a row, or two rows in turn whose first cell is empty: signs of merged cells."""
    rows = F.transform(F.filter(F.split(table, r"[\r\n]+"), lambda x: (F.trim(x) != "") & ~(x.rlike(r"^[\s|:\-]+$") & x.contains("-"))), cells)
    twins = F.exists(rows, lambda r: F.exists(F.zip_with(r, F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), lambda a, b: (a == b) & (a != "")), lambda x: F.coalesce(x, F.lit(False))))
    empty = F.transform(rows, lambda r: F.coalesce(F.get(r, F.lit(0)) == "", F.lit(False)))
    gaps = F.exists(F.zip_with(empty, F.slice(empty, F.lit(2), F.greatest(F.size(empty) - 1, F.lit(0))), lambda a, b: a & F.coalesce(b, F.lit(False))), lambda x: x)
    return twins | gaps


class _Reader(HTMLParser):
    """Cells, spans and head rows of one table, tables inside its cells being text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[str, int, int]]] = []
        self.heads = self.depth = 0
        self.in_head = self.complex = False
        self.cell: list[str] | None = None
        self.span = (1, 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.depth += 1
        if self.depth != 1:
            return
        if tag == "thead":
            self.in_head = True
        elif tag in ("tbody", "tfoot"):
            self.in_head = False
        elif tag == "tr":
            self.close()
            self.rows.append([])
            self.heads += self.in_head
        elif tag in ("td", "th") and self.rows:
            self.close()
            self.cell, self.span = [], tuple(self.number(dict(attrs).get(k)) for k in ("rowspan", "colspan"))  # type: ignore[assignment]

    def number(self, value: str | None) -> int:
        if value is None:
            return 1
        ok = value.strip().isdigit() and int(value) > 0
        self.complex |= not ok or int(value) > 1
        return min(int(value), 1000) if ok else 1

    def close(self) -> None:
        if self.cell is not None:
            self.rows[-1].append((re.sub(r"\s+", " ", "".join(self.cell)).strip(), *self.span))
            self.cell = None

    def handle_endtag(self, tag: str) -> None:
        if self.depth == 1 and tag in ("td", "th", "tr", "table"):
            self.close()
        if tag == "thead":
            self.in_head = False
        if tag == "table":
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def parse_html(table: str) -> tuple[list[str], list[list[str]], bool]:
    """(columns, rows, complex) of an HTML table, merged cells repeated; the head is the last head row, or the first row."""
    r = _Reader()
    r.feed(table)
    r.close()
    grid: list[list[str]] = []
    below: dict[int, tuple[str, int]] = {}
    for row in r.rows:
        out: list[str] = []
        todo = list(row)
        while todo or len(out) in below:
            at = len(out)
            if at in below:
                text, left = below.pop(at)
                out.append(text)
                if left > 1:
                    below[at] = (text, left - 1)
                continue
            text, down, across = todo.pop(0)
            for _ in range(across):
                if down > 1:
                    below[len(out)] = (text, down - 1)
                out.append(text)
        grid.append(out)
    if not grid:
        return [], [], r.complex
    heads = max(1, r.heads)
    width = max(map(len, grid))
    fit = [(x + [""] * width)[:width] for x in grid]
    return fit[heads - 1], fit[heads:], r.complex or r.heads > 1


def parse_text(text: str) -> list[dict]:
    """All tables of a text, pipe tables first, then HTML tables, each with its place; empty ones are left out."""
    out = []
    for m in re.finditer(PIPE_TABLE, text):
        lines = [x for x in m.group().splitlines() if x.strip()]
        row = lambda x: [c.strip() for c in x.split("|")[1:-1]]
        head = row(lines[0])
        rows = [r for r in map(row, lines[2:]) if len(r) == len(head)]
        if len(lines) >= 3 and rows:
            out.append({"source_format": "markdown", "columns": head, "rows": rows, "is_complex": False, "start": m.start(), "end": m.end()})
    for start, end in html_tables(text):
        columns, rows, hard = parse_html(text[start:end])
        if rows:
            out.append({"source_format": "html", "columns": columns, "rows": rows, "is_complex": hard, "start": start, "end": end})
    return out


def parse_tables(text: str | Column) -> Column:
    """array of TABLE structs; null for a null text."""
    return by_value(parse_text, f"array<{TABLE}>")(text)


def table_units(units: DataFrame) -> DataFrame:
    """(doc_id, seq, table_no, table): every table of every unit."""
    from ..workers import importable

    importable(units.sparkSession)
    return units.select("doc_id", "seq", F.posexplode(parse_tables("content")).alias("table_no", "table"))


def table_html(columns: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    head = "".join(f"<th>{escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{escape(c)}</td>" for c in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def merge_pages(pages: list[str], decide=None) -> str:
    """Joins the pages of a document, merging a table that goes on at the top of the next page into the one that is open.

    ``decide(columns, columns)`` says "new_row", "continue_cell" or "stop"; by
    default equal heads go on with new rows and other tables stand alone.  Any
    text before the first table of a page, or after the last of the one before,
    closes the table.
    """
    decide = decide or (lambda a, b: "new_row" if a == b else "stop")
    out: list[str] = []
    open_: tuple[list[str], list[list[str]]] | None = None

    def close() -> None:
        nonlocal open_
        if open_:
            out.append(table_html(*open_))
            open_ = None

    for page in pages:
        at = 0
        for span in [*html_tables(page), None]:
            before = page[at : span[0] if span else len(page)].strip()
            if before:
                close()
                out.append(before)
            if span is None:
                break
            columns, rows, _ = parse_html(page[slice(*span)])
            verdict = decide(open_[0], columns) if open_ else "stop"
            if open_ and verdict == "new_row":
                open_[1].extend(rows if columns == open_[0] else [columns, *rows])
            elif open_ and verdict == "continue_cell" and open_[1]:
                open_[1][-1] = [" ".join(filter(None, x)) for x in itertools.zip_longest(open_[1][-1], columns)]
                open_[1].extend(rows)
            else:
                close()
                open_ = (columns, rows)
            at = span[1]
    close()
    return "\n\n".join(out)


def merge_units(group: Column | str, units: DataFrame, order: str = "seq") -> DataFrame:
    """One unit of each group: contents joined by blank lines, captions by "; ", pages united and sorted; the table itself is dropped."""
    joined = lambda c, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[c]), sep)
    pages = F.array_sort(F.array_distinct(F.flatten(F.collect_list("page_numbers"))))
    return units.groupBy(group).agg(joined("content", "\n\n").alias("content"), joined("caption", "; ").alias("caption"), F.when(F.size(pages) > 0, pages).alias("page_numbers"), F.min_by("context_path", order).alias("context_path"))


def pipe_blocks(text: Column) -> Column:
    """Maximal runs of lines that start with a pipe, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?m)((?:^\|[^\n]*(?:\n|$))++)"), 1)


def even_rows(rows: Column) -> Column:
    """Rows filled up with empty cells to the length of the longest."""
    return let(F.array_max(F.transform(rows, lambda r: F.size(r))), lambda width: F.transform(rows, lambda r: repair_row(r, width)))


def first_row_as_head(rows: Column) -> Column:
    """struct(columns, rows): the first row is the head; no rows give null."""
    return F.when(F.size(rows) > 0, F.struct(F.get(rows, F.lit(0)).alias("columns"), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))).alias("rows")))


def dangling(page: str) -> tuple[str, str]:
    """(fragment, rest) of a page that begins inside a table: up to the matching end tag, "" if it doesn't begin so."""
    if not re.match(r"(?i)\s*<(tr|td|th|tbody|thead)\b", page):
        return "", page
    depth = 1
    for m in re.finditer(r"(?i)<(/?)table\b[^>]*>", page):
        depth += -1 if m.group(1) else 1
        if depth == 0:
            return page[: m.start()], page[m.end() :]
    return page, ""


def some_rows(table: str, first: int = 0, last: int = 0) -> list[str]:
    """The first and last rows of an HTML table as they are written, none twice."""
    rows = re.findall(r"(?is)<tr\b.*?</tr\s*>", table)
    return rows if first + last >= len(rows) else rows[:first] + (rows[-last:] if last else [])


def heading_before(text: str, at: int) -> str | None:
    """The last Markdown heading before a place."""
    found = re.findall(r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*$", text[:at])
    return found[-1] if found else None
