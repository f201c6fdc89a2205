"""Knowledge graphs as node, edge and evidence tables; closures by recursive queries or doubling joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmill.operators.rounds import closure


def compile_edges(relations: DataFrame, head: str, relation: str, tail: str, doc: str, confidence: str, source: str) -> DataFrame:
    """Support, documents, mean/min/max confidence and sources of each edge."""
    return relations.groupBy(head, relation, tail).agg(
        F.count("*").alias("support"), F.count_distinct(doc).alias("documents"), F.avg(confidence).alias("confidence_mean"),
        F.min(confidence).alias("confidence_min"), F.max(confidence).alias("confidence_max"), F.array_sort(F.collect_set(source)).alias("sources"),
    )


def compile_nodes(mentions: DataFrame, node: str, label: str, label_rank: str, doc: str) -> DataFrame:
    """Occurrences, documents and the label of best rank of each node."""
    return mentions.groupBy(node).agg(F.count("*").alias("occurrences"), F.count_distinct(doc).alias("documents"), F.min_by(label, F.struct(label_rank, label)).alias("label"))


def neighbors(edges: DataFrame, direction: str = "both", least: int = 1, most: int = 10) -> DataFrame:
    """Each node's neighbours ranked by support: outgoing, incoming or both."""
    out = edges.select(F.col("head").alias("node"), F.col("tail").alias("other"), "relation", "support", F.lit("out").alias("side"))
    back = edges.select(F.col("tail").alias("node"), F.col("head").alias("other"), "relation", "support", F.lit("in").alias("side"))
    rows = {"out": out, "in": back, "both": out.unionByName(back)}[direction].where(F.col("support") >= least)
    w = W.partitionBy("node").orderBy(F.desc("support"), "other", "relation", "side")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def ancestors(edges: DataFrame, depth: int = 20) -> DataFrame:
    """The IS_A closure of (child, parent): least distance to each ancestor, in rounds of joins; cycles end by themselves."""
    return closure(edges, depth).select("node", "ancestor", "distance")


def shortest_paths(edges: DataFrame, depth: int = 20) -> DataFrame:
    """The least path (by length, then by its nodes) from each node to each ancestor."""
    return closure(edges, depth, paths=True).select("node", "ancestor", "path")


def invalid_codes(entities: DataFrame, matrix: DataFrame) -> DataFrame:
    """Entities whose (entity_type, code_system) is in no row of the validity matrix."""
    return entities.join(F.broadcast(matrix), ["entity_type", "code_system"], "left_anti")  # 16 types by 8 systems at most


def invalid_relations(relations: DataFrame, signatures: DataFrame) -> DataFrame:
    """Relations whose (type, head_type, tail_type) has no signature."""
    return relations.join(F.broadcast(signatures), ["type", "head_type", "tail_type"], "left_anti")  # a fixed table


def active_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ontology edges between active nodes, without loops and repeats."""
    ids = nodes.where("not obsolete").select("id")
    e = edges.where("child <> parent").distinct()
    return e.join(ids.withColumnRenamed("id", "child"), "child", "left_semi").join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi").select("child", "parent")
