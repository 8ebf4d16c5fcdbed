"""A corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents; the last
adds `shard`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, mixing, quality, sharding, simhash
from tessera.llm.common import shared_dir, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field takes for good."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row with a test item; items of fewer words don't count."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated or left out so that sources meet their target weights."""
    return mixing.mix_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every record with its shard; shards are of near equal bytes."""
    return sharding.write_order(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("source mixing", mixed),
    ("sharding", sharded),
]

#: The field and the fingerprints have no SQL; tests/llm/test_pipeline.py compares run() with plain Python.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over `documents`; what each keeps lies in the shared folder until the next one's output does.

    The last but one's output stays, as the returned DataFrame reads it.
    """
    docs = table(spark, sf_dir, "documents")
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{home}/{k}")
            docs = spark.read.parquet(f"{home}/{k}")
            if k:
                _remove(spark, f"{home}/{k - 1}")
    return docs
