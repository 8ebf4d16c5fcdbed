"""Sharding by sampled splitters, with DataFrame functions alone.

A record's key is (digest of the text, doc_id), so copies stand together and
can still be told apart. A size-weighted sample of keys gives splitters; the
ranges between them are summed exactly; ranges that hold more than twice their
share are sampled anew and subdivided. Prefix sums over the few ranges and
within each range then place every record on one line of bytes, which is cut
into equal shards. The sample decides only how evenly the work is dealt, never
the result.

Ranges grow with the records, so that a range is some RANGE_ROWS of them, up to
MOST_RANGES; beyond (1.6 billion records) ranges themselves grow. Splitters go
out as a table: for each of the 4096 first three digits of a digest, how many
splitters stand before and which have these digits. Records meet it by a
broadcast join (at most MOST_RANGES keys in all) and search their few splitters
in halves, so plans don't grow.

Sizes: the driver holds at most 4 * MOST_RANGES sampled keys and the ranges'
sums, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, free_name

#: Ranges wanted for each shard at least, records in a range, ranges at most, keys drawn for each range.
RANGES_PER_SHARD, RANGE_ROWS, MOST_RANGES, KEYS_PER_RANGE = 8, 100_000, 16_384, 4
#: Keys drawn at least, and rounds of subdividing at most.
SAMPLE, ROUNDS = 8192, 12
_LEAST = -(1 << 63)
_SPLITTER = "struct<digest: string, id: long>"


def _key() -> Column:
    return F.struct(F.col("digest"), F.coalesce("doc_id", F.lit(_LEAST)).alias("id"))


def _placed(rows: DataFrame, splitters: list[tuple[str, int]]) -> DataFrame:
    """rows (digest, doc_id, ...) with `range`: the number of splitters at or below the record's key."""
    by: dict[str, list] = {}
    for d, i in splitters:
        by.setdefault(d[:3], []).append((d, i))
    table, at = [], 0
    for k in range(4096):
        own = by.get(f"{k:03x}", [])
        table.append((f"{k:03x}", at, own))
        at += len(own)
    few = rows.sparkSession.createDataFrame(table, f"head string, before int, own array<{_SPLITTER}>")
    j = rows.join(F.broadcast(few), F.substring("digest", 1, 3) == F.col("head"))  # 4096 rows, at most MOST_RANGES keys
    n = F.size("own")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(map(len, by.values()), default=1).bit_length()))])
    own = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get("own", F.least(at + step, n) - 1) <= _key()), at + step).otherwise(at))
    return j.withColumn("range", F.col("before") + own).drop("head", "before", "own")


def _draw(rows: DataFrame, n: int) -> list[tuple[str, int]]:
    """n keys, drawn with a probability by size: the n smallest of -ln(u)/size, u a hash of the key. Reruns draw the same."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("draw"), "digest", "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    top = rows.select("digest", F.coalesce("doc_id", F.lit(_LEAST)).alias("id"), (-F.log(u) / F.col("size")).alias("r")).orderBy("r", "digest", "id").limit(n)
    return sorted((x.digest, x.id) for x in top.collect())


def _spread(keys: list, n: int) -> list:
    """n-1 quantiles of sorted keys, each once."""
    return sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []


def splitters(rows: DataFrame, ranges: int) -> tuple[list[tuple[str, int]], dict[int, tuple[int, int]]]:
    """Splitters of rows (digest, doc_id, size), and (bytes, rows) of the ranges between them."""
    n = max(SAMPLE, KEYS_PER_RANGE * ranges)
    cuts = _spread(_draw(rows, n), ranges)
    for turn in range(ROUNDS):
        placed = _placed(rows, cuts)
        sums = {x.range: (x.bytes, x.n) for x in placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        fair = sum(b for b, _ in sums.values()) / max(1, ranges)
        over = [k for k, (b, m) in sums.items() if b > 2 * fair and m > 1]
        if not over or turn == ROUNDS - 1 or len(cuts) >= 2 * MOST_RANGES:
            return cuts, sums
        few = rows.sparkSession.createDataFrame([(k,) for k in over], "range int")
        drawn = _draw(placed.join(F.broadcast(few), "range", "left_semi"), n)
        more: set = set()
        for k in over:
            low, high = cuts[k - 1] if k else None, cuts[k] if k < len(cuts) else None
            inside = [x for x in drawn if (low is None or x > low) and (high is None or x < high)]
            more |= set(_spread(inside, 1 + round(sums[k][0] / fair)))
        if not more - set(cuts):
            return cuts, sums
        cuts = sorted({*cuts, *more})
    return cuts, sums


def record_sizes(docs: DataFrame) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.substring(F.md5(raw), 1, 16).alias("digest"))


def shard_records(docs: DataFrame, shards: int = 40) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Deal documents to shards of near equal bytes (law `bytes`).

    docs: doc_id (integer), text; other columns are ignored. Returns rows of
    doc_id, size, text_crc32, digest, shard, slot, and (shard, first key) of
    each shard that has records, in order. A size is the UTF-8 bytes of the
    text (null: none) plus 16; a very long text is one record. The record
    whose middle lies in the shard's part of the line of all bytes is in the
    shard, so a shard is off by less than its largest record. Slots are 0, 1,
    2 ... in the order of the keys. Null doc_ids stand first; repeated rows
    stand side by side, each with a slot of its own. Fewer records than shards
    leave shards empty; an empty table gives no rows.
    """
    rows = cut(record_sizes(docs))
    n = rows.count()
    cuts, sums = splitters(rows, min(MOST_RANGES, max(shards * RANGES_PER_SHARD, n // RANGE_ROWS)))
    spark = docs.sparkSession
    total = sum(b for b, _ in sums.values())
    base, at, nth = [], 0, 0
    for k in sorted(sums):
        base.append((k, at, nth))
        at, nth = at + sums[k][0], nth + sums[k][1]
    ranges = spark.createDataFrame(base or [(0, 0, 0)], "range int, base_bytes long, base_rows long")
    rows = _placed(rows, cuts).join(F.broadcast(ranges), "range")  # a row for each range
    order = Window.partitionBy("range").orderBy("digest", F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    before = F.col("base_bytes") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = rows.withColumn("nth", F.col("base_rows") + F.row_number().over(order) - 1).withColumn("middle", 2 * before + F.col("size"))
    shard = F.least(F.floor(F.col("middle").cast("decimal(38,0)") * shards / (2 * max(1, total))), F.lit(shards - 1)).cast("int")
    rows = cut(rows.select("doc_id", "size", "text_crc32", "digest", shard.alias("shard"), "nth"))
    firsts = rows.groupBy("shard").agg(F.min(F.struct("nth", "digest", F.coalesce("doc_id", F.lit(_LEAST)).alias("id"))).alias("x"))
    firsts = sorted((x.shard, x.x.nth, (x.x.digest, x.x.id)) for x in firsts.collect())  # a row for each shard
    starts = spark.createDataFrame([x[:2] for x in firsts] or [(0, 0)], "shard int, first long")
    out = rows.join(F.broadcast(starts), "shard").withColumn("slot", F.col("nth") - F.col("first"))
    return out.select("doc_id", "size", "text_crc32", "digest", "shard", "slot"), [(s, key) for s, _, key in firsts]


def write_order(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The documents themselves in the order of shards and slots, with all their columns and a last one `shard`.

    A column `shard` is replaced. A shard is a range of keys, so whole texts
    move once, dealt by ranges of (digest, doc_id) and sorted: a partition has
    a stretch of slots of one shard or of a few neighbours, also where a third
    of all records are copies. Records with one key (repeated rows, and null
    doc_ids with one text) stay together, in the last of the shards that
    shard_records() gives them. Other cases are as there. An empty table gives an empty table.
    """
    _, firsts = shard_records(docs, shards)
    docs = docs.drop("shard")
    digest, key = free_name(docs, "digest"), free_name(docs, "id")
    docs = docs.withColumn(digest, F.substring(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")), 1, 16)).withColumn(key, F.coalesce("doc_id", F.lit(_LEAST)))
    shard = F.lit(firsts[0][0] if firsts else 0)
    for s, (d, i) in firsts[1:]:  # one for each shard
        shard = F.when((F.col(digest) > d) | ((F.col(digest) == d) & (F.col(key) >= i)), s).otherwise(shard)
    dealt = docs.withColumn("shard", shard.cast("int")).repartitionByRange(digest, key).sortWithinPartitions(digest, key)
    return dealt.drop(digest, key)


def op3(spark, sf_dir):
    rows, _ = shard_records(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 by table over the bytes, then the line of all bytes cut into 40 parts.
ORACLE = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [0::BIGINT,0,0,0,0,0,0,0]),
           lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c
    FROM range(256) r(i))
), d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), s AS (
  SELECT doc_id, CAST(strlen(text) + 16 AS BIGINT) AS size, substr(md5(text), 1, 16) AS digest, hex(encode(text)) AS h FROM d
), b AS (
  SELECT doc_id, size, digest,
         xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
             list_transform(range(0, strlen(h) // 2), lambda i: (instr('123456789ABCDEF', h[2*i+1]) * 16 + instr('123456789ABCDEF', h[2*i+2]))::BIGINT)),
             lambda c, x: xor(c >> 8, tab.t[(xor(c & 255, x)) + 1]))) AS crc
  FROM s, tab
), o AS (
  SELECT *, row_number() OVER w - 1 AS nth,
         2 * CAST(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS middle,
         CAST(sum(size) OVER () AS BIGINT) AS total
  FROM b WINDOW w AS (ORDER BY digest, doc_id NULLS FIRST, size, crc)
), p AS (
  SELECT *, CAST(least(CAST(middle AS HUGEINT) * 40 // (2 * total), 39) AS INTEGER) AS shard FROM o
)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(nth - min(nth) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""
