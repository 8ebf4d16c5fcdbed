"""Row-wise enrichment of nodes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# Fixed values, which must be these for the same results: patterns of entities, and words that are none.
ENTITY_PATTERNS = {
    "PERSON": r"\b[A-Z][a-z]+ [A-Z][a-z]+\b",
    "ORG": r"\b[A-Z][A-Za-z\s]+ (?:Inc|Corp|LLC|Ltd|Company|Corporation|Group|Systems|Technologies|Solutions)\b",
    "DATE": r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4})\b",
    "MONEY": r"\$[\d,]+(?:\.\d{2})?|\b\d+(?:,\d{3})*(?:\.\d{2})? (?:dollars?|USD|euros?|EUR)\b",
    "EMAIL": T.EMAIL,
    "PHONE": r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
    "URL": r"\bhttps?://[^\s]+\b",
    "LOCATION": r"\b(?:in|at|from|to) ([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)\b",
}
NO_ENTITIES = ["the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]
# End of the fixed values.


def statistics(c: Column) -> Column:
    words = T.whitespace_words(c)
    n = F.size(words)
    return F.struct(F.octet_length(c).cast("long").alias("bytes"), n.cast("long").alias("words"), T.count_lines(c).alias("lines"), T.count_paragraphs(c).alias("paragraphs"), F.when(n > 0, F.aggregate(words, F.lit(0), lambda s, w: s + F.octet_length(w)) / n).otherwise(0.0).alias("avg_word_bytes"))


def structure(c: Column) -> Column:
    return F.struct(*[F.regexp_count(c, F.lit(p)).cast("long").alias(k) for k, p in T.PATTERNS.items()])


def frequent_words(docs: DataFrame, n: int = 10, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each document's alphabetic words of over 3 bytes, the n most frequent; of these, those with more than one."""
    w = F.filter(T.whitespace_words(F.lower(F.col(text))), lambda x: F.regexp_like(x, F.lit(r"^\p{L}+$")) & (F.octet_length(x) > 3))
    rows = docs.select(id_col, F.explode(w).alias("word")).groupBy(id_col, "word").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "word"))
    return rows.withColumn("_r", r).filter((F.col("_r") <= n) & (F.col("n") > 1)).drop("_r")


def _related(a: Column, b: Column, label: str) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(F.lit(label).alias("label"), x.alias("source"), y.alias("target")))


def entities(c: Column, most: int | None = None, labels: list[str] | None = None) -> Column:
    """Entities of 2 to 100 bytes by pattern: label, text, confidence, start and end (code points), in the order of their places.

    Of neighbours with one label and text the first stays. `most` keeps the
    first so many of a text, `labels` only these kinds. Null has none. Python's
    patterns know the places of matches; Spark's functions give texts alone.
    """
    found = [(k, re.compile(p), 1 if k == "LOCATION" else 0) for k, p in ENTITY_PATTERNS.items() if labels is None or k in labels]

    def of(text: str | None) -> list[dict]:
        out = []
        for label, pattern, group in found:
            for m in pattern.finditer(text or ""):
                own = m.group(group)
                if 2 <= len(own.encode()) <= 100 and own.lower() not in NO_ENTITIES:
                    out.append({"label": label, "text": own, "confidence": 0.8 if label == "LOCATION" else 0.9, "start": m.start(group), "end": m.end(group)})
        out.sort(key=lambda e: e["start"])
        out = [e for i, e in enumerate(out) if not i or (e["text"], e["label"]) != (out[i - 1]["text"], out[i - 1]["label"])]
        return out[:most]

    @F.pandas_udf("array<struct<label: string, text: string, confidence: double, start: int, end: int>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(of)

    return run(c)


def grouped_entities(found: Column, threshold: float = 0.0) -> Column:
    """A map from each label to its entities' texts, those of at least the threshold, in their order."""
    sure = F.filter(found, lambda e: e["confidence"] >= threshold)
    labels = F.array_sort(F.array_distinct(F.transform(sure, lambda e: e["label"])))
    return F.map_from_arrays(labels, F.transform(labels, lambda k: F.transform(F.filter(sure, lambda e: e["label"] == k), lambda e: e["text"])))


def known_relations(related: Column, found: Column) -> Column:
    """Relations (label, source, target) whose two ends are entities, whatever their case."""
    names = F.transform(found, lambda e: F.lower(e["text"]))
    return F.filter(related, lambda r: F.array_contains(names, F.lower(r["source"])) & F.array_contains(names, F.lower(r["target"])))


def relations(c: Column) -> Column:
    """WORKS_AT and LOCATED_IN pairs by pattern, as label, source, target."""
    out = []
    for label, p in (("WORKS_AT", r"([A-Z][a-z]+ [A-Z][a-z]+) works (?:at|for) ([A-Z]\w+)"), ("LOCATED_IN", r"([A-Z]\w+) is (?:located|based) in ([A-Z]\w+)")):
        a, b = (F.regexp_extract_all(c, F.lit(p), F.lit(i)) for i in (1, 2))
        out.append(_related(a, b, label))
    return F.concat(*out)


def parse_keywords(reply: Column, n: int = 5) -> Column:
    """A model's comma list: lower-cased, sorted, each once, the first n."""
    return F.slice(F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.lower(reply), ","), lambda x: F.trim(x)), lambda x: x != ""))), 1, n)


def parse_triplets(reply: Column, most: int | None = None, max_bytes: int = 128) -> Column:
    """`(subject, predicate, object)` lines of a model's reply; long, circular and repeated ones are left out; the first `most` if given."""
    p = F.lit(r"\(([^,()]+),([^,()]+),([^,()]+)\)")
    s, v, o = (F.transform(F.regexp_extract_all(reply, p, F.lit(i)), lambda x: F.trim(x)) for i in (1, 2, 3))
    all_ = F.zip_with(F.arrays_zip(s.alias("s"), v.alias("v")), o, lambda a, b: F.struct(F.lower(a["s"]).alias("s"), F.lower(a["v"]).alias("p"), F.lower(b).alias("o")))
    ok = F.filter(all_, lambda x: (x["s"] != x["o"]) & (F.octet_length(x["s"]) <= max_bytes) & (F.octet_length(x["o"]) <= max_bytes) & ~x["p"].isin(T.STOP_WORDS))
    own = F.array_distinct(ok)
    return own if most is None else F.slice(own, 1, most)


def text_features(c: Column) -> Column:
    n = F.greatest(F.char_length(c), F.lit(1))
    words = T.count_words(c)
    return F.struct((F.regexp_count(c, F.lit(r"\s")) / n).alias("space_ratio"), (F.regexp_count(c, F.lit(r"[!-/:-@\[-`{-~]")) / n).alias("punct_ratio"), (words / 225.0).alias("reading_minutes"))


def neighbours(nodes: DataFrame, doc: str = "doc_id", pos: str = "chunk_index", node: str = "node_id") -> DataFrame:
    w = Window.partitionBy(doc).orderBy(pos)
    return nodes.withColumn("prev_id", F.lag(node).over(w)).withColumn("next_id", F.lead(node).over(w))


def titles_per_document(nodes: DataFrame, n: int = 3, doc: str = "doc_id", pos: str = "chunk_index", text: str = "content") -> DataFrame:
    """A title for each document from its first n nodes' titles, joined to all its nodes."""
    w = Window.partitionBy(doc).orderBy(pos)
    first = nodes.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    t = first.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", T.title(F.col(text)).alias("t")))), lambda x: x["t"]), " | ").alias("document_title"))
    return nodes.join(t, doc, "left")


def embed(docs: DataFrame, text: str = "text", dims: int = 64) -> DataFrame:
    """Feature-hashing embedding: counts of terms by hash, unit length. A stand-in for a model where there is none."""
    w = T.terms(F.col(text))
    slots = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(dims)))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    n = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda s, x: s + x * x))
    return docs.withColumn("_raw", raw).withColumn("embedding", F.transform("_raw", lambda x: F.when(n == 0, 0.0).otherwise(x / n))).drop("_raw")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)
