"""Duplicates among documents and among results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def by_content(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each content once: hash, the smallest id, how many have it. Only hashes move."""
    return docs.select(id_col, T.document_hash(F.col(text)).alias("hash")).groupBy("hash").agg(F.min(id_col).alias(id_col), F.count("*").alias("n"))


def best_per(hits: DataFrame, key: list[str], id_col: str = "doc_id") -> DataFrame:
    """The row with the highest score for each key; ties by id."""
    w = Window.partitionBy(*key).orderBy(F.desc("score"), id_col)
    return hits.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def status(docs: DataFrame, known: DataFrame, strategy: str = "upserts", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """process, skip or update for each document against known (id, hash)."""
    old = known.select(id_col, F.col("hash").alias("old"))
    rows = docs.select(id_col, T.document_hash(F.col(text)).alias("hash")).join(old, id_col, "left")
    changed = "skip" if strategy == "duplicates_only" else "update"
    return rows.select(id_col, "hash", F.when(F.col("old").isNull(), "process").when(F.col("old") == F.col("hash"), "skip").otherwise(changed).alias("status"))


def deleted(docs: DataFrame, known: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Known ids that are gone from the documents (upserts and delete)."""
    return known.join(docs, id_col, "left_anti").select(id_col)


def adjacent(rows: DataFrame, by: list[str], order: str, same: list[str]) -> DataFrame:
    """Of rows that follow each other (within `by`, by `order`) with equal values in `same`, the first."""
    w = Window.partitionBy(*by).orderBy(order)
    again = F.lag(F.struct(*same)).over(w).eqNullSafe(F.struct(*same))
    return rows.withColumn("_again", again).filter("not _again").drop("_again")


def unseen(nodes: DataFrame, known: DataFrame, key: str = "hash") -> DataFrame:
    return nodes.join(known, key, "left_anti")


def greedy(hits: DataFrame, query: list[str], id_col: str, words: str, threshold: float = 0.8, limit: int = 1000) -> DataFrame:
    """For each query, rows in falling score whose word Jaccard with every kept row is below the threshold.

    Only the best `limit` results of a query are compared, as a result list is
    what this is for; those beyond pass on unchanged, compared with none.
    """
    w = Window.partitionBy(*query).orderBy(F.desc("score"), id_col)
    rows = hits.withColumn("_r", F.row_number().over(w))
    top, rest = rows.filter(F.col("_r") <= limit), rows.filter(F.col("_r") > limit).drop("_r")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r")
        kept, sets = [], []
        for i, own in enumerate(map(frozenset, pdf[words])):
            if all(len(own & s) < threshold * max(1, len(own | s)) for s in sets):
                kept.append(i)
                sets.append(own)
        return pdf.iloc[kept].drop(columns="_r")

    return top.groupBy(*query).applyInPandas(pick, hits.schema).union(rest)


def diversity(hits: DataFrame, query: list[str], id_col: str, words: str, threshold: float = 0.8, penalty: float = 0.5, top_n: int = 10) -> DataFrame:
    """For each query top_n rows, chosen one by one: the best first, then always the one whose score less penalty * its largest Jaccard to chosen ones (if over the threshold) is best.

    `words` are the rows' words as an array. Rows keep their scores and get
    `rank`, the order of choice from 1; ties go to the higher score, then id.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema.fields) + ", rank int"

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", id_col], ascending=[False, True], kind="stable").reset_index(drop=True)
        sets, scores = [frozenset(x) for x in pdf[words]], pdf["score"].to_numpy(float)
        like = np.full(len(pdf), -np.inf)  # the largest similarity to a chosen row
        left = np.ones(len(pdf), bool)
        chosen = []
        while left.any() and len(chosen) < top_n:
            worth = np.where(left, scores - np.where(like > threshold, penalty * like, 0.0), -np.inf)
            i = int(worth.argmax()) if np.isfinite(worth).any() else int(left.argmax())
            left[i] = False
            chosen.append(i)
            for j in np.flatnonzero(left):
                both = len(sets[i] & sets[j])
                union = len(sets[i]) + len(sets[j]) - both
                like[j] = max(like[j], both / union if union else 0.0)
        return pdf.iloc[chosen].assign(rank=range(1, len(chosen) + 1))

    return hits.groupBy(*query).applyInPandas(pick, schema)


def jaccard_to(hits: DataFrame, query: list[str], text: str = "text") -> DataFrame:
    """Reranking by word Jaccard with the query."""
    q = F.array(*[F.lit(x.lower()) for x in sorted(set(query))])
    return hits.withColumn("score", T.jaccard(F.array_distinct(T.terms(F.col(text))), q))
