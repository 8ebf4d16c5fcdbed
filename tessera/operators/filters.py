"""Filters and postprocessors on scored rows."""

from __future__ import annotations

import re
import warnings
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def metadata_equals(**want) -> Column:
    """All of the columns equal their values; a null fails."""
    return reduce(lambda a, b: a & b, (F.coalesce(F.col(k) == v, F.lit(False)) for k, v in want.items()), F.lit(True))


def keyword_predicate(text: Column, required: list[str], excluded: list[str] = (), min_matches: int = 1, case_sensitive: bool = False) -> Column:
    """At least min_matches of the required words or phrases and none of the excluded, between word boundaries of any script."""

    def found(w: str) -> Column:
        return F.regexp_like(text, F.lit(("(?U)" if case_sensitive else "(?iU)") + r"\b" + re.sub(r"([^\w\s])", r"\\\1", w) + r"\b"))

    hits = sum((F.when(found(w), 1).otherwise(0) for w in required), F.lit(0))
    none = reduce(lambda a, b: a & b, (~found(w) for w in excluded), F.lit(True))
    return ((hits >= min_matches) if required else F.lit(True)) & none


def metadata_predicate(required: dict | None = None, excluded: dict | None = None, require_all: bool = True) -> Column:
    """Values are compared as strings; a missing one matches nothing."""
    same = [F.coalesce(F.col(k).cast("string") == str(v), F.lit(False)) for k, v in (required or {}).items()]
    want = (reduce(lambda a, b: a & b, same) if require_all else reduce(lambda a, b: a | b, same)) if same else F.lit(True)
    bad = [F.coalesce(F.col(k).cast("string") == str(v), F.lit(False)) for k, v in (excluded or {}).items()]
    return want & ~reduce(lambda a, b: a | b, bad, F.lit(False))


def similarity_cutoff(hits: DataFrame, cutoff: float = 0.7, most: int | None = None, order: str = "rank") -> DataFrame:
    """Scores of at least the cutoff, then the first `most` in the order that the input carries."""
    out = hits.filter(F.col("score") >= cutoff)
    return out if most is None else out.orderBy(order).limit(most)


def content_length(text: Column, low: int | None = None, high: int | None = None) -> Column:
    n = F.octet_length(text)
    return (n >= low if low is not None else F.lit(True)) & (n <= high if high is not None else F.lit(True))


def admit(docs: DataFrame, min_bytes: int = 10, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Contents of at least min_bytes, each content once, with its smallest id."""
    return docs.filter(F.octet_length(text) >= min_bytes).groupBy(F.sha2(text, 256).alias("hash")).agg(F.min(id_col).alias(id_col))


def recent(rows: DataFrame, ts: str, days: int, now: Column | None = None) -> DataFrame:
    at = F.current_timestamp() if now is None else now
    return rows.filter(F.col(ts) >= at - F.make_interval(days=F.lit(days)))


def chain(rows: DataFrame, steps: list, continue_on_error: bool = False) -> DataFrame:
    """Steps in turn; a step that Spark can't plan stops the chain, or is left out with a warning."""
    for step in steps:
        try:
            rows = step(rows)
        except AnalysisException as e:
            if not continue_on_error:
                raise
            warnings.warn(f"left out {getattr(step, '__name__', step)}: {e}", stacklevel=2)
    return rows


def compression_metrics(before: Column, after: Column, relevance: Column) -> Column:
    ratio = F.when(before > 0, after / before).otherwise(F.lit(1.0))
    return F.struct(ratio.alias("ratio"), ((1 - ratio) * relevance).alias("efficiency"), (relevance / F.greatest(ratio, F.lit(1e-9))).alias("retention"))


def sentence_optimizer(hits: DataFrame, query: list[str], share: float = 0.7, threshold: float = 0.0, context: int = 1, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Keeps the best ceil(n * share) sentences of at least the threshold (or the best one), with `context` neighbours.

    A sentence's relevance is the share of the query's words that it has.
    Sentences are rejoined by ". "; the new score is the mean of the old one
    and the kept sentences' mean relevance.
    """
    s = hits.select(id_col, "score", F.posexplode(T.sentences(F.col(text))).alias("pos", "s"))
    words = T.terms(F.col("s"), 1)
    rel = sum((F.when(F.array_contains(words, q.lower()), 1.0).otherwise(0.0) for q in query), F.lit(0.0)) / len(query)
    by = Window.partitionBy(id_col)
    s = s.withColumn("rel", rel).withColumn("n", F.count("*").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.desc("rel"), "pos")))
    core = ((F.col("r") <= F.ceil(F.col("n") * share)) & (F.col("rel") >= threshold)) | (F.col("r") == 1)
    s = s.withColumn("core", core)
    near = F.max(F.col("core").cast("int")).over(by.orderBy("pos").rowsBetween(-context, context)) == 1
    kept = s.withColumn("near", near).filter("near")
    return kept.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), ". ").alias("content"), ((F.first("score") + F.avg("rel")) / 2).alias("score"), F.count("*").alias("kept"))
