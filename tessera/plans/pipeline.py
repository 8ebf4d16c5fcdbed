"""Indexing pipelines: lists of DataFrame functions with checks at the borders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

Step = Callable[[DataFrame], DataFrame]


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has the columns."""
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"columns are missing: {', '.join(lost)}")
    return df


@dataclass
class IndexingPipeline:
    """documents -> one splitter -> node steps -> embedding -> store. Lazy until something is written."""

    splitter: Step | None = None
    node_steps: list[Step] = field(default_factory=list)
    embedder: Step | None = None

    def nodes(self, docs: DataFrame) -> DataFrame:
        if self.splitter is None:
            own = require(docs, "doc_id", "content").select("doc_id", F.lit(0).alias("chunk_index"), "content", F.concat_ws("-", "doc_id", F.lit(0)).alias("node_id"))
        else:
            own = require(self.splitter(docs), "doc_id", "content", "node_id")
        own = reduce(lambda d, f: require(f(d), "node_id", "content"), self.node_steps, own)
        return self.embedder(own) if self.embedder else own

    def run(self, docs: DataFrame, store=None, doc_store=None) -> DataFrame:
        """Nodes of the documents that doc_store doesn't know unchanged; both stores get what is new."""
        if doc_store is not None:
            known = doc_store.read().select("doc_id", F.col("hash").alias("_old"))
            docs = docs.withColumn("_new", T.document_hash(F.col("content"), F.col("metadata"))).join(known, "doc_id", "left")
            docs = docs.filter(F.col("_old").isNull() | (F.col("_old") != F.col("_new"))).drop("_old", "_new")
        nodes = self.nodes(docs)
        if store is not None:
            store.add(nodes.select("node_id", "content", "embedding", F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string")).alias("metadata")))
        if doc_store is not None:
            doc_store.add(docs.select("doc_id", "content", "metadata"))
        return nodes

    def cache_key(self, docs: DataFrame, name: str, config: str = "") -> DataFrame:
        return docs.select("doc_id", F.sha2(F.concat(F.col("content"), F.lit(name), F.lit(config)), 256).alias("key"))


def cached(spark, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A transform's result, kept as Parquet under its key's path."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
    make().write.parquet(path)
    return spark.read.parquet(path)
