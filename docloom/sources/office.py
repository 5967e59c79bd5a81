"""Office files as Markdown, read with the standard library: they are zip archives of XML."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def pipe_table(rows: list[list[str]]) -> str:
    """A pipe table whose head is the first row; short rows are filled up."""
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in r + [""] * (width - len(r))) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


def _number(name: str) -> int:
    return int(re.findall(r"\d+", name)[-1])


def docx(data: bytes) -> str:
    """Paragraphs with headings by their styles, list items and tables, in order."""

    def text(p) -> str:
        return "".join(t.text or "" if t.tag == W + "t" else "\n" if t.tag == W + "br" else "\t" for t in p.iter() if t.tag in (W + "t", W + "br", W + "tab")).strip()

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
    out = []
    for e in body if body is not None else ():
        if e.tag == W + "p" and text(e):
            style = e.find(f"{W}pPr/{W}pStyle")
            level = re.fullmatch(r"(?i)heading\s*([1-6])", style.get(W + "val", "")) if style is not None else None
            mark = "#" * int(level.group(1)) + " " if level else "- " if e.find(f"{W}pPr/{W}numPr") is not None else ""
            out.append(mark + text(e))
        elif e.tag == W + "tbl":
            out.append(pipe_table([[" ".join(filter(None, map(text, c.iter(W + "p")))) for c in row.findall(W + "tc")] for row in e.findall(W + "tr")]))
    return "\n\n".join(out)


def pptx(data: bytes) -> str:
    """Slides in order, each under its number; the paragraphs and tables of its shapes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number)
        slides = [ElementTree.fromstring(z.read(n)) for n in names]
    out = []
    text = lambda p: "".join(t.text or "" for t in p.iter(A + "t")).strip()
    for k, slide in enumerate(slides, 1):
        out.append(f"## Slide {k}")
        inside = {p for t in slide.iter(A + "tbl") for p in t.iter(A + "p")}
        out += [text(p) for p in slide.iter(A + "p") if p not in inside and text(p)]
        out += [pipe_table([[text(c) for c in row.findall(A + "tc")] for row in t.findall(A + "tr")]) for t in slide.iter(A + "tbl")]
    return "\n\n".join(out)


def xlsx(data: bytes) -> str:
    """Sheets in order, each a pipe table under its name; values as they are stored."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(S + "t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(S + "si")]
        sheets = [(s.get("name"), ElementTree.fromstring(z.read("xl/" + links[s.get(R + "id")].removeprefix("/xl/")))) for s in book.iter(S + "sheet")]
    out = []
    for name, sheet in sheets:
        rows: list[list[str]] = []
        for row in sheet.iter(S + "row"):
            cells: list[str] = []
            for c in row.findall(S + "c"):
                column = 0
                for letter in re.match(r"[A-Z]*", c.get("r", "")).group():  # type: ignore[union-attr]
                    column = column * 26 + ord(letter) - 64
                cells += [""] * (column - 1 - len(cells))
                value = c.find(S + "v")
                if c.get("t") == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(S + "t")))
                elif value is None or value.text is None:
                    cells.append("")
                elif c.get("t") == "s":
                    cells.append(shared[int(value.text)])
                else:
                    cells.append(value.text)
            rows.append(cells)
        out += [f"## {name}", pipe_table(rows)]
    return "\n\n".join(x for x in out if x)
