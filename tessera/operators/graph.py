"""Property graphs as two tables: vertices (id, name, label) and edges (source, label, target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def vertex_id(name: Column) -> Column:
    return F.md5(name)


def valid_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends exist, each (source, label, target) once."""
    ids = vertices.select("id")
    e = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return e.select("source", "label", "target").distinct()


def triplets(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    s = vertices.select(F.col("id").alias("source"), F.col("name").alias("source_name"), F.col("label").alias("source_label"))
    t = vertices.select(F.col("id").alias("target"), F.col("name").alias("target_name"), F.col("label").alias("target_label"))
    return edges.join(s, "source").join(t, "target")


def matching(found: DataFrame, entities: list[str] | None = None, relations: list[str] | None = None, ids: list[str] | None = None) -> DataFrame:
    """Triplets with a named entity at an end, a relation label, and an id at an end; without any condition, none."""
    if entities is None and relations is None and ids is None:
        return found.limit(0)
    if entities is not None:
        found = found.filter(F.col("source_name").isin(entities) | F.col("target_name").isin(entities) | F.col("source").isin(entities) | F.col("target").isin(entities))
    if relations is not None:
        found = found.filter(F.col("label").isin(relations))
    if ids is not None:
        found = found.filter(F.col("source").isin(ids) | F.col("target").isin(ids))
    return found


def k_hop(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """id and the least number of hops (either way along edges) from the start ids, up to depth."""
    both = edges.select("source", "target").union(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    seen = start.select("id").distinct().withColumn("hops", F.lit(0))
    front = seen
    for hop in range(1, depth + 1):
        step = front.join(both, front["id"] == both["source"]).select(F.col("target").alias("id")).distinct()
        front = step.join(seen, "id", "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.union(front)
    return seen


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("id")).union(edges.select(F.col("target").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def triplet_text() -> Column:
    return F.concat_ws(" ", "source_name", F.lower(F.regexp_replace("label", "_", " ")), "target_name")


def scored_triplets(found: DataFrame, query: str, relation_words: dict[str, list[str]], threshold: float = 0.3) -> DataFrame:
    """.4 for an end that the query names, .3 for a relation that its words mean, .3 * Jaccard of the texts; each text once."""
    own = query.lower().split()
    named = [F.array_contains(F.array(*map(F.lit, own)), F.lower(F.col(c))) | F.lower(F.lit(query)).contains(F.lower(F.col(c))) for c in ("source_name", "target_name")]
    meant = [k for k, ws in relation_words.items() if set(ws) & set(own)]
    words = F.array(*[F.lit(w) for w in sorted(set(own))])
    text = triplet_text()
    score = F.when(named[0] | named[1], 0.4).otherwise(0.0) + F.when(F.col("label").isin(meant), 0.3).otherwise(0.0) + 0.3 * T.jaccard(F.array_distinct(F.split(F.lower(text), " ")), words)
    return found.select(text.alias("text"), score.alias("score")).filter(F.col("score") >= threshold).groupBy("text").agg(F.max("score").alias("score"))
