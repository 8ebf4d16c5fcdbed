"""Fusion of ranked lists: rows of list_id, id, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _list():
    return Window.partitionBy("list_id")


def _weights(weights: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("list_id").cast("int") + 1)


def rrf(lists: DataFrame, k: float = 60.0) -> DataFrame:
    """Sum of 1 / (rank + k), ranks from 0 in each list."""
    rank = F.row_number().over(_list().orderBy(F.desc("score"), "id")) - 1
    return lists.withColumn("r", 1 / (rank + k)).groupBy("id").agg(F.sum("r").alias("score"))


def min_max(lists: DataFrame) -> DataFrame:
    """Scores of each list from 0 to 1; unchanged where all are equal."""
    low, high = F.min("score").over(_list()), F.max("score").over(_list())
    return lists.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.col("score")))


def z_score(lists: DataFrame) -> DataFrame:
    mean, dev = F.avg("score").over(_list()), F.greatest(F.stddev_pop("score").over(_list()), F.lit(1e-6))
    return lists.withColumn("score", (F.col("score") - mean) / dev)


def rank_score(lists: DataFrame) -> DataFrame:
    """Scores of each list by rank: 1 for the best, 1/n for the last of n."""
    n, rank = F.count("*").over(_list()), F.row_number().over(_list().orderBy(F.desc("score"), "id"))
    return lists.withColumn("score", (n - rank + 1) / n)


def weighted_average(lists: DataFrame, weights: list[float], normalize: bool = True) -> DataFrame:
    """Weighted mean over the lists that have the id."""
    x = (min_max(lists) if normalize else lists).withColumn("w", _weights(weights))
    return x.groupBy("id").agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("score"))


def linear(lists: DataFrame, weights: list[float], normalize: bool = True) -> DataFrame:
    x = (min_max(lists) if normalize else lists).withColumn("w", _weights(weights))
    return x.groupBy("id").agg(F.sum(F.col("w") * F.col("score")).alias("score"))


def distribution_based(lists: DataFrame, weights: list[float]) -> DataFrame:
    """Weighted sum of sigmoids of z-scores."""
    x = z_score(lists).withColumn("w", _weights(weights))
    return x.groupBy("id").agg(F.sum(F.col("w") / (1 + F.exp(-F.col("score")))).alias("score"))


def concat(lists: DataFrame) -> DataFrame:
    """Each id with its score in the first list that has it."""
    return lists.groupBy("id").agg(F.min_by("score", "list_id").alias("score"))


def distance_based(lists: DataFrame, weights: list[float], metric: str = "euclidean") -> DataFrame:
    s = F.col("score")
    turned = {"cosine": 1 - s, "euclidean": 1 / (1 + s)}.get(metric, s)
    return concat(lists.withColumn("score", turned * _weights(weights)))


def keep_max(lists: DataFrame) -> DataFrame:
    return lists.groupBy("id").agg(F.max("score").alias("score"))


def keep(lists: DataFrame, how: str) -> DataFrame:
    """average, maximum or minimum of an id's scores."""
    f = {"average": F.avg, "maximum": F.max, "minimum": F.min}[how]
    return lists.groupBy("id").agg(f("score").alias("score"))


def votes(lists: DataFrame) -> DataFrame:
    """How many lists have the id, with its first list's score."""
    return lists.groupBy("id").agg(F.count("*").alias("votes"), F.min_by("score", "list_id").alias("score"))


def fuse(method: str, lists: DataFrame, weights: list[float] | None = None, **args) -> DataFrame:
    """By name; the number of weights must be that of the lists."""
    named = {"rrf": rrf, "weighted": weighted_average, "linear": linear, "dbsf": distribution_based, "concat": concat, "distance": distance_based, "max": keep_max, "votes": votes}
    if method not in named:
        raise ValueError(f"no such fusion: {method}")
    if method in ("weighted", "linear", "dbsf", "distance"):
        n = lists.agg(F.max("list_id")).first()[0]
        if weights is None or (n is not None and len(weights) != n + 1):
            raise ValueError("one weight for each list is needed")
        return named[method](lists, weights, **args)
    return named[method](lists, **args)
