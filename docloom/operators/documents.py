"""Documents and their pages: merging, spans, lookup, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

JOINER = "\n\n"


def from_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text as a document of one page, number 1."""
    page = F.struct(F.lit(1).alias("page_number"), F.col(text).alias("content"), F.struct(F.lit(0).alias("start"), F.length(text).alias("end")).alias("span"))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("content"), F.array(page).alias("pages"))


def page_spans(pages: DataFrame, doc_id: str = "doc_id", order: str = "page_number", text: str = "content") -> DataFrame:
    """``pages`` with span_start and span_end, half-open places in the text joined by blank lines; null pages are empty."""
    w = Window.partitionBy(doc_id).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.coalesce(F.length(text), F.lit(0))
    end = F.sum(n + len(JOINER)).over(w) - len(JOINER)
    return pages.withColumns({"span_end": end, "span_start": end - n})


def merge(parts: DataFrame, doc_id: str = "doc_id", order: str = "page_number", text: str = "content") -> DataFrame:
    """(doc_id, content, pages) of all parts of each document in order, any number at once; page spans fit the joined text."""
    one = F.struct(F.col(order).alias("page_number"), F.coalesce(F.col(text), F.lit("")).alias("content"), F.struct(F.col("span_start").alias("start"), F.col("span_end").alias("end")).alias("span"))
    pages = F.array_sort(F.collect_list(one))
    return page_spans(parts, doc_id, order, text).groupBy(doc_id).agg(pages.alias("pages")).select(doc_id, F.array_join(F.transform("pages", lambda p: p["content"]), JOINER).alias("content"), "pages")


def get_page(pages: Column, number: Column | int) -> Column:
    """The first page of that number; null if there is none."""
    return F.get(F.filter(pages, lambda p: p["page_number"] == number), F.lit(0))


def pages_of_span(pages: Column, start: Column, end: Column) -> Column:
    """Numbers of the pages that the half-open span touches."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(pages, lambda p: (p["span"]["start"] < end) & (p["span"]["end"] > start)), lambda p: p["page_number"])))


def dump(documents: DataFrame, units: DataFrame | None, path: str) -> None:
    """Archive: documents and units as Parquet, spans, tables and all."""
    documents.write.mode("errorifexists").parquet(f"{path}/documents")
    if units is not None:
        units.write.mode("errorifexists").parquet(f"{path}/units")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/units")
    there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    return spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/units") if there else None


def items_to_pages(items: DataFrame, doc_id: str = "doc_id", page: str = "page_number", order: str = "item_no", text: str = "text") -> DataFrame:
    """Pages from a layout engine's typed items: a page's texts in order, joined by blank lines."""
    each = F.array_sort(F.collect_list(F.struct(order, text)))
    return items.groupBy(doc_id, page).agg(F.array_join(F.transform(each, lambda x: x[text]), JOINER).alias("content"))


def page_range(pages: DataFrame, first: int, last: int | None = None, number: str = "page_number") -> DataFrame:
    """Pages first to last, the end clamped to what there is."""
    from ..errors import InvalidInput

    if first < 1 or (last is not None and last < first):
        raise InvalidInput("page ranges start at 1 and don't run backwards")
    rows = pages.where(F.col(number) >= first)
    return rows if last is None else rows.where(F.col(number) <= last)


def best_view(views: Column, level: str) -> Column:
    """The first view of a level."""
    return F.get(F.filter(views, lambda v: v["level"] == level), F.lit(0))


def views_in_order(views: Column) -> Column:
    """Views from low to full; unknown levels last."""
    rank = lambda v: F.when(v["level"] == "low", 0).when(v["level"] == "medium", 1).when(v["level"] == "high", 2).when(v["level"] == "full", 3).otherwise(4)
    return F.transform(F.array_sort(F.transform(views, lambda v: F.struct(rank(v).alias("r"), v.alias("v")))), lambda x: x["v"])
