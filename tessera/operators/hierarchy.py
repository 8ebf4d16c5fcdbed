"""Parent and child nodes, auto-merging retrieval, runs of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leaves(nodes: DataFrame) -> DataFrame:
    parents = nodes.select(F.col("parent_id").alias("node_id")).filter(F.col("node_id").isNotNull()).distinct()
    return nodes.join(parents, "node_id", "left_anti")


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("parent_id").isNull())


def children(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    return nodes.join(parents.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi")


def deeper_than(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes with more than `depth` ancestors."""
    up = nodes.select("node_id", F.col("parent_id").alias("at"))
    own = nodes.select(F.col("node_id").alias("at"), F.col("parent_id").alias("next"))
    for _ in range(depth):
        up = up.filter("at is not null").join(own, "at").select("node_id", F.col("next").alias("at"))
    return nodes.join(up.filter("at is not null").select("node_id"), "node_id", "left_semi")


def child_counts(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.count("*").alias("child_count"), F.array_sort(F.collect_list("node_id")).alias("child_ids"))


def auto_merge(hits: DataFrame, nodes: DataFrame, threshold: float = 0.5, depth: int = 2) -> DataFrame:
    """Hits (node_id, score) in which a parent stands for its children when over `threshold` of them are hits.

    The parent's score is their mean; levels merge upward, at most `depth`.
    """
    tree = nodes.select("node_id", "parent_id")
    counts = child_counts(nodes).select("parent_id", "child_count")
    for _ in range(depth):
        own = hits.join(tree, "node_id", "left")
        merged = own.filter("parent_id is not null").groupBy("parent_id").agg(F.avg("score").alias("score"), F.count("*").alias("n")).join(counts, "parent_id").filter(F.col("n") / F.col("child_count") > threshold).select("parent_id", "score")
        rest = own.join(merged.select("parent_id"), "parent_id", "left_anti").select("node_id", "score")
        up = merged.select(F.col("parent_id").alias("node_id"), "score")
        hits = rest.join(up, "node_id", "left_anti").select("node_id", "score").union(up)
    return hits


def segments(hits: DataFrame, doc: str = "doc_id", pos: str = "chunk_index", most: int = 5) -> DataFrame:
    """Runs of neighbouring hits of a document, in pieces of at most `most`: first, last, number, mean score."""
    w = Window.partitionBy(doc).orderBy(pos)
    island = F.col(pos) - F.row_number().over(w)
    x = hits.withColumn("island", island)
    nth = F.row_number().over(Window.partitionBy(doc, "island").orderBy(pos)) - 1
    return x.withColumn("piece", F.floor(nth / most)).groupBy(doc, "island", "piece").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("n"), F.avg("score").alias("score")).drop("island", "piece")
