"""Mixing sources to target weights, with DataFrame functions alone.

Each document gets a hash-random key. Within a source, documents stand in the
order of their keys; a source's budget is that many whole passes over it and a
prefix of the next one. The prefix sums are distributed: a key's first hex
digits name one of 4096 ranges, ranges are summed (at most 4096 rows for each
source), and rows are summed within their (source, range) only. No task holds
a source, so one that has a third of all rows is dealt like the others.

Sources may be as many as hosts: they are numbered by ranges of their names
(counts of each range first, places within it then), and the level at which
weights are met comes from sums over all sources, so no task holds them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, free_name, word_count

#: Hex digits of a key that name its range.
DIGITS = 3
#: Sources whose rows (about 100 bytes each) are broadcast.
FEW_SOURCES = 50_000


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with `nth`, each row's place (from 0) by code points, null last. The driver holds one count for each partition."""
    rows = cut(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, at = [], 0
    for part, n in counts:
        before.append((part, at))
        at += n
    few = sources.sparkSession.createDataFrame(before or [(0, 0)], "part int, before long")
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return rows.join(F.broadcast(few), "part").withColumn("nth", F.col("before") + own).drop("part", "before")  # a row for each partition


def source_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """A target for each source: source, source_size, target.

    Sources in the order of their code points, null last, weigh 1, 2, 3 and
    so on again. The sum of all sizes is shared by weight; no target exceeds
    most times its source's size, and what is cut off is shared anew: at the
    level at which what is left is shared by weight among the sources that
    stay below their limit. Raising the level can only bring more sources to
    their limits, so it is raised until none is added.
    """
    s = _numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    s = s.withColumn("weight", F.col("nth") % 3 + 1).withColumn("cap", most * F.col("source_size"))
    s = cut(s.select("source", "source_size", "weight", "cap"))
    level, full = None, None
    while True:
        low = F.lit(False) if level is None else F.col("cap") < level * F.col("weight")
        x = s.agg(F.sum("source_size").alias("total"), F.coalesce(F.sum(F.when(low, F.col("cap"))), F.lit(0)).alias("cap"), F.sum(F.when(~low, F.col("weight"))).alias("weight"), F.count_if(low).alias("full")).first()
        if x.full == full or not x.weight:
            break
        level, full = (x.total - x.cap) / x.weight, x.full
    share = F.lit(level if level is not None else 0.0) * F.col("weight")
    target = F.when(share < F.col("cap"), share).otherwise(F.col("cap").cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def _placed(docs: DataFrame, most: int, seed: str) -> DataFrame:
    """Each document's place in its source's order: what mix_sources() returns, and key, passes and part."""
    rows = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    rows = rows.withColumn("key", _key(seed)).withColumn("range", F.substring("key", 1, DIGITS))
    targets = source_targets(rows, most).withColumnRenamed("source", "target_source")
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("base", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).drop("range_size")
    ranges = ranges.join(targets, F.col("source").eqNullSafe(F.col("target_source"))).select("base", "source_size", "target", F.col("source").alias("r_source"), F.col("range").alias("r_range"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = rows.join(ranges, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
    budget = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.greatest(budget - passes * F.col("source_size") - F.col("base") - F.col("inner"), F.lit(0))
    out = out.withColumn("passes", passes).withColumn("part", F.least(rest, F.col("size")))
    extra = (F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))
    copies = F.when(F.col("size") > 0, F.col("passes") + F.when(extra, 1).otherwise(0)).otherwise(0).cast("long")
    taken = (F.col("passes") * F.col("size") + F.col("part")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"), "key", "passes", "part")


def _key(seed: str):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def mix_sources(docs: DataFrame, most: int = 3, seed: str = "mix") -> DataFrame:
    """How many words of each document the mix takes.

    docs: doc_id, source, text; other columns are ignored. Returns doc_id,
    source, size (words), source_size, target, taken, copies. taken: words,
    repeats counted; a source's sum is its target, rounded, and the document
    at the cut gives a part. copies: how often a mix of whole documents takes
    this one; the document at the cut is in it if at least half of it fits.
    Null and empty texts have no words and are never taken; a very long one
    counts whole, in part at the cut. Null is a source of its own; rows with
    the same doc_id stand in the order of their sizes. Reruns give the same
    rows. An empty table gives an empty table.
    """
    return _placed(docs, most, seed).drop("key", "passes", "part")


def mix_documents(docs: DataFrame, most: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: whole documents with all their columns, each as often as mix_sources() counts copies.

    A source's last key of the final pass decides, and one row for each source
    is joined to the documents. Up to FEW_SOURCES these rows are broadcast and
    texts don't move; beyond, the join is a shuffled one of two exchanges, so
    adaptive execution splits a source that has many rows. Rows that share a
    doc_id and a size are taken together. Null and empty texts have no words
    and are never taken. An empty table gives an empty table.
    """
    placed = _placed(docs, most, seed).filter("size > 0")
    last = F.max(F.when(F.col("copies") > F.col("passes"), F.struct("key", "doc_id", "size")))
    names = size, key, source, passes, end, copy = [free_name(docs, x) for x in ("size", "key", "of_source", "passes", "last", "copy")]
    cuts = cut(placed.groupBy("source").agg(F.first("passes").alias(passes), last.alias(end)).withColumnRenamed("source", source))
    if cuts.count() <= FEW_SOURCES:
        cuts = F.broadcast(cuts)
    rows = docs.withColumn(size, word_count(F.col("text"))).filter(F.col(size) > 0).withColumn(key, _key(seed))
    rows = rows.join(cuts, F.col("source").eqNullSafe(F.col(source)))
    place = F.struct(F.col(key).alias("key"), F.col("doc_id").alias("doc_id"), F.col(size).alias("size"))
    copies = F.col(passes) + F.when(F.col(end).isNotNull() & (place <= F.col(end)), 1).otherwise(0)
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).drop(*names)


def op9(spark, sf_dir):
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS cap,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, cap / weight AS ratio,
         (CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(cap) OVER b, 0) AS BIGINT))
         / (CAST(sum(weight) OVER () AS BIGINT) - CAST(coalesce(sum(weight) OVER b, 0) AS BIGINT)) AS level
  FROM s WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
  SELECT arg_min(level, ratio) AS level FROM r WHERE level * weight <= cap
), t AS (
  SELECT source, source_size, least(v.level * weight, CAST(cap AS DOUBLE)) AS target FROM r LEFT JOIN v ON true
), p AS (
  SELECT d.*, source_size, target, CAST(round(target) AS BIGINT) AS budget,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + least(greatest(budget - (budget // source_size) * source_size - before, 0), size) END AS BIGINT) AS taken
FROM p
"""
