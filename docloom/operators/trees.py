"""Section trees: nodes as rows, outlines, descent and Monte-Carlo search."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import terms
from ..workers import importable

def tree_nodes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node_id, parent_id, ord, level, title, text, line_start, line_end).

    A heading is a trimmed line of one to six # and a title, outside fences of
    three backticks; its text reaches to the next heading, its own line
    included.  What stands before the first heading belongs to no node.  The
    parent is the last heading before of a smaller level.
    Documents are worked through by themselves, in Arrow batches; nothing is shuffled.
    """
    importable(docs.sparkSession)

    @F.pandas_udf("array<struct<node_id:string,parent_id:string,ord:int,level:int,title:string,text:string,line_start:int,line_end:int>>")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else sections(t))

    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(parse(F.col(text))).alias("n")).select("doc_id", "n.*")


BLANKS = " \t\n\x0b\f\r"
HEAD = re.compile(r"(#{1,6})[ \t]+(.+)$")


def sections(text: str) -> list[dict]:
    """The nodes of one Markdown text, in order."""
    out: list[dict] = []
    lines: list[str] = []
    open_: list[tuple[int, str]] = []
    fenced = False
    for k, line in enumerate(text.split("\n"), 1):
        bare = line.strip(" ")
        fence = bare.startswith("```")
        fenced ^= fence
        m = None if fence or fenced else HEAD.match(bare)
        if m:
            if out:
                out[-1]["text"] = "\n".join(lines).strip(BLANKS)
            lines = [line]
            level = len(m.group(1))
            open_ = [h for h in open_ if h[0] < level]
            name = str(len(out) + 1).zfill(4)[:4]
            out.append({"node_id": name, "parent_id": open_[-1][1] if open_ else None, "ord": len(out) + 1, "level": level, "title": m.group(2).strip(" "), "text": "", "line_start": k, "line_end": k})
            open_.append((level, name))
        elif out:
            lines.append(line)
            out[-1]["line_end"] = k
    if out:
        out[-1]["text"] = "\n".join(lines).strip(BLANKS)
    return out


def outline(nodes: DataFrame, summary: Column | None = None) -> DataFrame:
    """(doc_id, outline): one line per node in order, indented by level, "[id] title" and a summary if there is one."""
    extra = F.coalesce(F.concat(F.lit(": "), summary), F.lit("")) if summary is not None else F.lit("")
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("["), F.col("node_id"), F.lit("] "), F.col("title"), extra)
    each = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    return nodes.groupBy("doc_id").agg(F.array_join(F.transform(each, lambda x: x["line"]), "\n").alias("outline"))


def node_ids(answer: Column) -> Column:
    """The distinct four-digit ids in a judge's answer, in its order."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\b(\d{4})\b"), 1))


def summaries(nodes: DataFrame, summarise: Callable[[Column], Column] | None = None, small: int = 200, large: int = 500, head: int = 200) -> DataFrame:
    """Adds ``summary``, from the leaves up: a short text is its own; a parent's is its text and a line for each child.

    ``summarise`` is called on long texts; offline it cuts to ``head``
    characters.  There are six levels at most, so six joins, each checkpointed.
    """
    from ..folders import cut
    from ..functions.text import word_count

    brief = summarise or (lambda c: F.when(F.length(c) > head, F.concat(F.substring(c, 1, head), F.lit("..."))).otherwise(c))
    out = cut(nodes.withColumn("summary", F.lit(None).cast("string")))
    for level in range(6, 0, -1):
        lines = F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("- "), F.col("title"), F.lit(": "), F.substring("summary", 1, head)).alias("line"))))
        kids = out.where("parent_id IS NOT NULL AND summary IS NOT NULL").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("_kids"))
        joined = out.join(kids, ["doc_id", "node_id"], "left")
        own = F.when(word_count(F.col("text")) < small, F.col("text")).otherwise(brief(F.col("text")))
        both = F.concat_ws("\n", F.col("text"), F.col("_kids"))
        made = F.when(F.col("_kids").isNull(), own).when(word_count(both) > large, brief(both)).otherwise(both)
        out = cut(joined.withColumn("summary", F.when(F.col("level") == level, made).otherwise(F.col("summary"))).drop("_kids"))
    return out


def descend(nodes: DataFrame, chosen: Column, depth: int = 5, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All nodes reached from the roots through chosen ones: a node is reached if it and all above it are ``chosen``."""
    picked = nodes.where(chosen)
    level = picked.where("parent_id IS NULL")
    out = level
    for _ in range(depth - 1):
        level = picked.join(level.select(*keys, F.col("node_id").alias("parent_id")), [*keys, "parent_id"], "left_semi").select(*out.columns)
        out = out.unionByName(level)
    return out


@dataclass
class _Node:
    id: str
    value: float
    parent: _Node | None = None
    children: list[_Node] = field(default_factory=list)
    visits: int = 0
    total: float = 0.0


#: (rounds, exploration, nodes returned) of each preset.
PRESETS = {"fast": (10, 1.4, 3), "balanced": (30, 1.2, 5), "accurate": (50, 1.0, 8), "explore": (50, 2.0, 10)}


def mcts(rows: list[tuple[str, str | None, float]], iterations: int, top_k: int, c: float = math.sqrt(2)) -> list[tuple[str, float, int]]:
    """Upper-confidence search over (node, parent, relevance) in order: (node, mean value, visits), the best first.

    Root children are scored once; each round walks down by mean + c *
    sqrt(ln(visits of the parent) / visits), unvisited first, steps to the first
    child of a visited inner node, and adds the node's relevance on the way up.
    """
    root = _Node("", 0.0)
    by = {"": root}
    for name, parent, value in rows:
        up = by.get(parent or "", root)
        by[name] = _Node(name, value, up)
        up.children.append(by[name])

    def back(node: _Node | None, value: float) -> None:
        while node:
            node.visits += 1
            node.total += value
            node = node.parent

    for n in root.children:
        back(n, n.value)
    for _ in range(iterations):
        node = root
        while node.children and (node is root or node.visits):
            up = node
            node = max(up.children, key=lambda n: math.inf if not n.visits else n.total / n.visits + c * math.sqrt(math.log(max(1, up.visits)) / n.visits))
            if node.visits and node.children and not node.children[0].visits:
                node = node.children[0]
                break
            if not node.visits:
                break
        if node is root:
            break
        back(node, node.value)
    seen = [(n.id, n.total / n.visits, n.visits) for n in by.values() if n is not root and n.visits]
    return sorted(seen, key=lambda x: (-x[1], x[0]))[:top_k]


def search_tree(nodes: DataFrame, relevance: Column, iterations: int = 30, top_k: int = 3, keys: tuple[str, ...] = ("query_id", "doc_id"), c: float = math.sqrt(2)) -> DataFrame:
    """(keys, node_id, value, visits): Monte-Carlo search of each key's tree; trees are searched in parallel, one task's at a time."""
    importable(nodes.sparkSession)
    kinds = ", ".join(f"{k} {nodes.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        rows = [(n, None if pd.isna(p) else p, float(v)) for n, p, v in zip(pdf["node_id"], pdf["parent_id"], pdf["rel"], strict=True)]
        found = mcts(rows, iterations, top_k, c)
        out = pd.DataFrame(found, columns=["node_id", "value", "visits"])
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    rows = nodes.select(*keys, "node_id", "parent_id", "ord", relevance.cast("double").alias("rel"))
    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, node_id string, value double, visits bigint")


def lexical_relevance(query: Column, text: Column) -> Column:
    """The offline judge: share of the query's terms in the text."""
    q = F.array_distinct(terms(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, terms(text))) / F.size(q)).otherwise(0.0)


def to_nested(rows: list[dict]) -> list[dict]:
    """Forest of dictionaries from one document's node rows, nulls left out."""
    by: dict[str, dict] = {}
    roots: list[dict] = []
    for r in sorted(rows, key=lambda r: r["ord"]):
        node = {k: v for k, v in r.items() if v is not None and k not in ("doc_id", "parent_id", "ord")} | {"nodes": []}
        by[r["node_id"]] = node
        (by[r["parent_id"]]["nodes"] if r.get("parent_id") in by else roots).append(node)
    return roots


def from_nested(forest: list[dict], doc_id: object = None) -> list[dict]:
    """Node rows in order from a forest of dictionaries."""
    out: list[dict] = []

    def walk(nodes: list[dict], parent: str | None, level: int) -> Iterator[None]:
        for n in nodes:
            out.append({k: v for k, v in n.items() if k != "nodes"} | {"doc_id": doc_id, "parent_id": parent, "ord": len(out) + 1, "level": n.get("level", level)})
            yield from walk(n.get("nodes", []), n["node_id"], level + 1)

    list(walk(forest, None, 1))
    return out


def trees_of(units: DataFrame, level: str = "high") -> DataFrame:
    """Nodes of units (unit_id, views) from the view at ``level``, Markdown or text; units without that view have none."""
    views = units.select(F.col("unit_id").alias("doc_id"), F.get(F.filter("views", lambda v: v["level"] == level), F.lit(0))["content"].alias("text"))
    return tree_nodes(views.where("text IS NOT NULL"))


class TreeRetriever:
    """Answers (query_id, query) from trees of nodes with (query_id, doc_id, node_id, title, text, ...); ``judge`` is a column of query and text, offline the share of the query's terms."""

    def __init__(self, judge=None):
        self.judge = judge or lexical_relevance

    def search(self, nodes: DataFrame, queries: DataFrame) -> DataFrame:
        raise NotImplementedError

    def retrieve(self, queries: DataFrame, units: DataFrame) -> DataFrame:
        """From the views of the units that each query (query_id, query, unit_id) names."""
        nodes = trees_of(units.join(queries.select("unit_id").distinct(), "unit_id", "left_semi"))
        asked = queries.select("query_id", "query", F.col("unit_id").alias("doc_id"))
        return self.search(nodes, asked)

    def asked(self, nodes: DataFrame, queries: DataFrame) -> DataFrame:
        """Each query with the nodes of its document; queries without doc_id ask all trees, and are few."""
        pairs = nodes.join(queries, "doc_id") if "doc_id" in queries.columns else nodes.crossJoin(queries.select("query_id", "query"))
        return pairs.withColumn("relevance", self.judge(F.col("query"), F.coalesce("text", F.lit(""))).cast("double"))


class SimpleTree(TreeRetriever):
    """Descends from the roots through nodes whose relevance is at least ``least``, ``depth`` levels."""

    def __init__(self, depth: int = 5, least: float = 0.01, judge=None):
        super().__init__(judge)
        self.depth, self.least = depth, least

    def search(self, nodes: DataFrame, queries: DataFrame) -> DataFrame:
        return descend(self.asked(nodes, queries), F.col("relevance") >= self.least, self.depth, ("query_id", "doc_id"))


class SkeletonTree(TreeRetriever):
    """The k most relevant nodes of each tree, in order of relevance, then of the outline; with ``answers`` (query_id, doc_id, answer) the known ids that a judge names, in its order."""

    def __init__(self, k: int = 8, judge=None):
        super().__init__(judge)
        self.k = k

    def search(self, nodes: DataFrame, queries: DataFrame, answers: DataFrame | None = None) -> DataFrame:
        asked = self.asked(nodes, queries)
        if answers is None:
            w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("relevance"), "ord")
            return asked.where("relevance > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.k)
        named = answers.select("query_id", "doc_id", F.posexplode(node_ids(F.col("answer"))).alias("place", "node_id"))
        w = Window.partitionBy("query_id", "doc_id").orderBy("place")
        return asked.join(named, ["query_id", "doc_id", "node_id"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.k).drop("place")


class MctsTree(TreeRetriever):
    """Monte-Carlo search with a preset's rounds, exploration and number of nodes."""

    def __init__(self, preset: str = "balanced", judge=None):
        super().__init__(judge)
        self.iterations, self.c, self.k = PRESETS[preset]

    def search(self, nodes: DataFrame, queries: DataFrame) -> DataFrame:
        asked = self.asked(nodes, queries)
        found = search_tree(asked, F.col("relevance"), self.iterations, self.k, ("query_id", "doc_id"), self.c)
        return found.join(asked, ["query_id", "doc_id", "node_id"])
