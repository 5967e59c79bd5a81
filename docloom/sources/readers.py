"""Readers: files of several kinds as documents, and the kinds of sources."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MissingResource
from ..functions.text import by_value
from ..operators import trees
from ..workers import importable
from . import office

KINDS = {
    "pdf": "pdf", "docx": "word", "doc": "word", "pptx": "powerpoint", "ppt": "powerpoint", "xlsx": "excel", "xls": "excel", "csv": "csv", "json": "json", "jsonl": "json",
    "xml": "xml", "html": "html", "htm": "html", "md": "markdown", "markdown": "markdown", "txt": "text", "text": "text", "": "text", "png": "image", "jpg": "image", "jpeg": "image", "parquet": "parquet",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))


def is_url(path: Column) -> Column:
    return path.rlike("(?i)^https?://[^/ ]+")


def file_type(path: Column) -> Column:
    """Kind of a file by its ending; others are "unknown", none is "text"."""
    known = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("unknown"))


MIME = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "csv": "text/csv", "json": "application/json", "xml": "application/xml", "html": "text/html", "htm": "text/html", "md": "text/markdown", "txt": "text/plain", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
}


def mime_type(path: Column) -> Column:
    """Media type by the ending; null for others."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv)), extension(path))


class _Text(HTMLParser):
    BLOCKS = frozenset("p div section article header footer ul ol li table tr h1 h2 h3 h4 h5 h6 br hr blockquote pre".split())
    SILENT = frozenset("script style noscript template head".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0
        self.title: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag: str, attrs) -> None:
        self.in_title = self.in_title or tag == "title"
        if tag in self.SILENT:
            self.silent += 1
        elif tag in self.BLOCKS:
            self.out.append("\n" + ("#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "- " if tag == "li" else ""))

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        if not self.silent:
            self.out.append(data)


def html_to_markdown(html: str) -> str:
    """Visible text of a page: headings with their marks, list items with hyphens, blocks on lines of their own."""
    p = _Text()
    p.feed(html)
    p.close()
    lines = [re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in "".join(p.out).split("\n")]
    return "\n".join(x for x in lines if x and not re.fullmatch(r"#{1,6}|-", x))


def html_text(html: str | Column) -> Column:
    return by_value(html_to_markdown)(html)


def file_hash(content: str | Column) -> Column:
    """Hexadecimal xxHash64 of a file's bytes."""
    return by_value(lambda b: xxhash.xxh64(bytes(b)).hexdigest())(content)


Reader = Callable[[SparkSession, str], DataFrame]


def _binary(spark: SparkSession, path: str) -> DataFrame:
    importable(spark)
    return spark.read.format("binaryFile").load(path)


def _documents(files: DataFrame, text: Column, name: str) -> DataFrame:
    """(doc_id, content, pages, metadata) of whole files; the id is the hash of the bytes."""
    ext = extension(F.col("path"))
    info = F.struct(
        F.col("path").alias("source"), F.lit("local").alias("source_type"), file_type(F.col("path")).alias("file_type"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.col("length").alias("file_size"),
        ext.alias("file_extension"), F.col("doc_id").alias("md5"), F.length("text").cast("bigint").alias("content_length"), mime_type(F.col("path")).alias("mime_type"), F.col("modificationTime").alias("created_at"), F.lit(name).alias("reader_name"),
    )
    page = F.struct(F.lit(1).alias("page_number"), F.col("text").alias("content"), F.struct(F.lit(0).alias("start"), F.length("text").alias("end")).alias("span"))
    rows = files.withColumn("doc_id", file_hash("content")).withColumn("text", text)
    return rows.select("doc_id", F.col("text").alias("content"), F.array(page).alias("pages"), info.alias("metadata"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return _documents(_binary(spark, path), F.decode("content", "UTF-8"), "text")


def read_html(spark: SparkSession, path: str) -> DataFrame:
    return _documents(_binary(spark, path), html_text(F.decode("content", "UTF-8")), "html")


def _office(kind: str) -> Reader:
    def read_office(spark: SparkSession, path: str) -> DataFrame:
        convert = getattr(office, kind)
        return _documents(_binary(spark, path), by_value(lambda b: convert(bytes(b)))("content"), kind)

    return read_office


def read_markdown_tree(spark: SparkSession, path: str) -> DataFrame:
    """Section nodes of Markdown files."""
    return trees.tree_nodes(read_text(spark, path), "doc_id", "content")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Documents whose pages another tool extracted: JSON lines of doc_id, page_number, content."""
    from ..operators.documents import merge

    return merge(spark.read.schema("doc_id string, page_number int, content string").json(path))


READERS: dict[str, Reader] = {
    "text": read_text,
    "markdown": read_text,
    "html": read_html,
    "docx": _office("docx"),
    "pptx": _office("pptx"),
    "xlsx": _office("xlsx"),
    "markdown_tree": read_markdown_tree,
    "pages": read_pages,
    "csv": lambda s, p: s.read.option("header", True).csv(p),
    "json": lambda s, p: s.read.json(p),
    "parquet": lambda s, p: s.read.parquet(p),
    "orc": lambda s, p: s.read.orc(p),
    "xml": lambda s, p: s.read.option("rowTag", "row").xml(p),
}


def register(kind: str, reader: Reader) -> None:
    """Adds a reader, such as one for PDF or scans, whose libraries aren't here."""
    READERS[kind] = reader


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind not in READERS:
        raise MissingResource(f"no reader for {kind!r}; there are {sorted(READERS)}")
    return READERS[kind](spark, path)
