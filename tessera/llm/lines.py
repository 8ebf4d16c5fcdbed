"""Line dedup: drop lines that many documents share, with DataFrame functions alone.

Plan: lines are exploded to 128-bit key hashes with their positions, reduced to
one row for each (hash, document), counted, and the few keys over the threshold
are joined back, which gives each document the positions that it loses. Only
then do whole texts move, once, to meet these positions; the text is put
together again from the positions that are left. Nothing is compared line by
line with a document's list of lost keys: set operations on positions take
time in proportion to the lines. The counts are partial sums on the map side, so
a line in every document costs one row for each task; the rows of keys are
written before the join back, a plain shuffled join of two exchanges, which
adaptive execution splits where one key is hot. Nothing is broadcast unless
Spark itself sees that it is small, and joins sort, so they can spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS, ascii_lower, cut


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _hash(line: Column, min_chars: int) -> Column:
    """128 bits of a line's key; null where the key is too short to count."""
    key = _key(line)
    low = ascii_lower(key)
    return F.when(F.char_length(key) >= min_chars, F.struct(F.xxhash64(low).alias("a"), F.xxhash64(F.lit(7), low).alias("b")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_dedup(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """Drop every line whose key is in min_docs documents or more, but for the largest doc_id that holds it.

    docs: doc_id, text; other columns are ignored, so their names cannot
    clash. Returns doc_id, n_lines, n_dropped, kept (string). A key is the
    line without ASCII white space at both ends, A-Z lower-cased; keys shorter
    than min_chars code points are never dropped. Null or empty text is one
    empty line. Documents are told apart by doc_id: repeated rows count once
    and each get the same result; two texts that share a doc_id are judged
    as one document, each by its own lines. Rows whose doc_id is null count for
    nothing and keep all their lines. A very long text is one row, with some 30
    bytes for each of its lines besides. An empty table gives an empty table.
    """
    docs = docs.select("doc_id", "text")
    hashes = F.transform(_lines(F.col("text")), lambda x: _hash(x, min_chars))
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("of"), F.posexplode(hashes).alias("pos", "h"))
    rows = rows.filter(F.col("h").isNotNull()).select("doc_id", "of", "pos", "h.a", "h.b")
    common = rows.select("a", "b", "doc_id").distinct().groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).filter(F.col("n") >= min_docs)
    common = cut(common.select("a", "b", "last"))
    gone = rows.join(common, ["a", "b"]).filter(F.col("doc_id") < F.col("last"))
    lost = gone.groupBy("doc_id", "of").agg(F.collect_set("pos").alias("lost"))
    lines = docs.select("doc_id", F.xxhash64("text").alias("of"), _lines(F.col("text")).alias("line"))  # before the join, so that they are split once
    both = lines.join(lost, ["doc_id", "of"], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("line") - 1), F.col("lost"))  # in ascending order, by a hash set
    kept = F.when(F.col("lost").isNull(), F.col("line")).otherwise(F.transform(left, lambda i: F.get("line", i)))
    return both.select("doc_id", F.size("line").cast("long").alias("n_lines"), F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept"))


def op10(spark, sf_dir):
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), hot AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, pos, line, hot.key IS NOT NULL AND k.doc_id < hot.last AS gone FROM k LEFT JOIN hot ON k.key = hot.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
