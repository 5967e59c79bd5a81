"""Property graphs and unit relations as tables of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def merge_nodes(nodes: DataFrame, order: str = "batch") -> DataFrame:
    """One node per (label, id): properties united, the last in ``order`` wins for a name, ties by value."""
    each = nodes.select("label", "id", order, F.explode_outer("props").alias("name", "value"))
    w = Window.partitionBy("label", "id", "name").orderBy(F.desc(order), F.desc("value"))
    last = each.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    pairs = F.filter(F.collect_list(F.struct("name", "value")), lambda x: x["name"].isNotNull())
    return last.groupBy("label", "id").agg(F.map_from_entries(F.array_sort(pairs)).alias("props"))


def create_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends exist, each (ends, type, properties) once."""
    n = nodes.select("label", "id").distinct()
    ok = edges.join(n.toDF("src_label", "src"), ["src_label", "src"], "left_semi").join(n.toDF("dst_label", "dst"), ["dst_label", "dst"], "left_semi")
    same = ["src_label", "src", "dst_label", "dst", "rel_type"]
    if "props" not in edges.columns:
        return ok.dropDuplicates(same).select(*edges.columns)
    kind = edges.schema["props"].dataType
    # Maps can't be compared; their entries in order can.
    what = F.array_sort(F.map_entries("props")).cast("string") if isinstance(kind, T.MapType) else F.col("props").cast("string")
    return ok.withColumn("_props", what).dropDuplicates([*same, "_props"]).select(*edges.columns)


def relationships(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(label, id, rel_type, other_label, other): each node's edges out, in, or both."""
    out = edges.select(F.col("src_label").alias("label"), F.col("src").alias("id"), "rel_type", F.col("dst_label").alias("other_label"), F.col("dst").alias("other"))
    into = edges.select(F.col("dst_label").alias("label"), F.col("dst").alias("id"), "rel_type", F.col("src_label").alias("other_label"), F.col("src").alias("other"))
    return {"out": lambda: out, "in": lambda: into, "both": lambda: out.unionByName(into)}[direction]()


def get_node(nodes: DataFrame, label: str, id: str) -> DataFrame:
    return nodes.where((F.col("label") == label) & (F.col("id") == id))


def with_ids(nodes: DataFrame) -> DataFrame:
    """Nodes without an id get one of eight hexadecimal digits, from their label and properties, so that a repeated run gives the same."""
    made = F.substring(F.sha2(F.concat_ws("\x1f", F.col("label"), F.array_sort(F.map_entries("props")).cast("string")), 256), 1, 8)
    return nodes.withColumn("id", F.coalesce("id", made))


def related(edges: DataFrame, label: str, id: str, direction: str = "out", rel_type: str | None = None, target: str | None = None) -> DataFrame:
    """One node's relationships, of a type and to a target if these are given."""
    out = relationships(edges, direction).where((F.col("label") == label) & (F.col("id") == id))
    if rel_type is not None:
        out = out.where(F.col("rel_type") == rel_type)
    return out if target is None else out.where(F.col("other") == target)


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes ``gone`` (label, id) and all edges at them."""
    g = gone.select("label", "id")
    left = nodes.join(g, ["label", "id"], "left_anti")
    kept = edges.join(g.toDF("src_label", "src"), ["src_label", "src"], "left_anti").join(g.toDF("dst_label", "dst"), ["dst_label", "dst"], "left_anti")
    return left, kept.select(*edges.columns)


def update_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Properties of existing nodes overlaid by those of ``changes`` (label, id, props)."""
    c = changes.select("label", "id", F.col("props").alias("_new"))
    kept = F.map_filter("props", lambda k, _: ~F.array_contains(F.map_keys("_new"), k))
    return nodes.join(c, ["label", "id"], "left").withColumn("props", F.when(F.col("_new").isNotNull(), F.map_concat(kept, "_new")).otherwise(F.col("props"))).drop("_new")


def node_count(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("n"))


def match_path(edges: DataFrame, *rel_types: str) -> DataFrame:
    """(n0, n1, ...): ids along paths of edges of the given types in turn; a path goes on at a node of the same label and id."""
    path = None
    for k, rel in enumerate(rel_types):
        here, there = (f"n{k}", f"l{k}"), (f"n{k + 1}", f"l{k + 1}")
        step = edges.where(F.col("rel_type") == rel).select(F.col("src").alias(here[0]), F.col("src_label").alias(here[1]), F.col("dst").alias(there[0]), F.col("dst_label").alias(there[1]))
        path = step if path is None else path.join(step, list(here))
    return path.select(*(f"n{k}" for k in range(len(rel_types) + 1)))


INVERSE = {"references": "referenced_by", "referenced_by": "references", "parent": "children", "children": "parent", "related_to": "related_to"}
SINGLE = ("parent", "caption_of")


def both_ways(relations: DataFrame) -> DataFrame:
    """(src, rel, dst) with the inverse of each relation that has one, each once; self-relations stay as they are."""
    pairs = F.create_map(*(F.lit(x) for kv in INVERSE.items() for x in kv))
    back = relations.select(F.col("dst").alias("src"), F.try_element_at(pairs, F.col("rel")).alias("rel"), F.col("src").alias("dst")).where("rel IS NOT NULL")
    return relations.select("src", "rel", "dst").unionByName(back).distinct()


def single_valued(relations: DataFrame, order: str) -> DataFrame:
    """Of the relations that a unit can have once, the last in ``order`` stays."""
    w = Window.partitionBy("src", "rel").orderBy(F.desc(order), F.desc("dst"))
    once = F.col("rel").isin(*SINGLE)
    return relations.withColumn("_rn", F.when(once, F.row_number().over(w)).otherwise(1)).where("_rn = 1").drop("_rn")


def as_map(relations: DataFrame) -> DataFrame:
    """(src, relations map): as units carry them."""
    per = relations.groupBy("src", "rel").agg(F.array_sort(F.collect_set("dst")).alias("to"))
    return per.groupBy("src").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rel", "to")))).alias("relations"))
