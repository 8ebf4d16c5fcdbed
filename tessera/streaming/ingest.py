"""Incremental indexing and monitoring over streams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dedup

#: Rows of a block and blocks of a larger one, as in DuckDB's windows.
FANOUT = 16
#: Windows of time that a task takes at once; one row in STRETCH goes out twice.
STRETCH = 12


def stream_table(spark: SparkSession, folder: str, schema, glob: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (r.option("pathGlobFilter", glob) if glob else r).parquet(folder)


def index_stream(docs: DataFrame, store, checkpoint: str, transform=lambda d: d, strategy: str = "upserts"):
    """Runs a stream of (doc_id string, content, metadata) into a DocumentStore; unchanged documents are skipped."""

    def batch(df: DataFrame, _: int) -> None:
        df = df.dropDuplicates(["doc_id"])
        known = store.read().select("doc_id", "hash")
        from tessera.functions.text import document_hash

        hashed = df.withColumn("hash", document_hash(F.col("content"), F.col("metadata")))
        old = known.withColumnRenamed("hash", "old")
        fresh = hashed.join(old, "doc_id", "left").filter(F.col("old").isNull() | ((F.col("old") != F.col("hash")) & F.lit(strategy != "duplicates_only")))
        store.add(transform(fresh.select("doc_id", "content", "metadata")))

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _range_sums(v: np.ndarray, first: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of v[begin:end] for each pair, added as DuckDB adds a window's frames, so that doubles have the SQL's last bits.

    Sums of aligned blocks of FANOUT rows, of FANOUT blocks and so on; a range
    is added from left to right out of single rows at its ends and the largest
    blocks between. first: the position of v[0] among all rows, which aligns
    the blocks; those at the ends of v that lack rows are in no range.
    """
    levels, lows = [v], [first]
    while len(levels[-1]) > FANOUT:
        x, low = levels[-1], lows[-1] // FANOUT
        rows = np.zeros((-(-(lows[-1] + len(x)) // FANOUT) - low, FANOUT))
        rows.reshape(-1)[lows[-1] - low * FANOUT :][: len(x)] = x
        own = np.zeros(len(rows))
        for i in range(FANOUT):
            own += rows[:, i]
        levels.append(own)
        lows.append(low)
    total = np.zeros(len(begin))

    def add(level: int, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        x, a, b = levels[level], a - lows[level], b - lows[level]
        for i in range(int((b - a).max(initial=0))):
            on = np.flatnonzero(a + i < b)
            total[at[on]] += x[a[on] + i]

    at, a, b, right = np.arange(len(begin)), begin + first, end + first, []
    for level in range(len(levels)):
        up, down = a // FANOUT, b // FANOUT
        last = (up == down) | (level == len(levels) - 1)
        whole = a % FANOUT == 0
        add(level, at, a, np.where(last, b, np.where(whole, a, (up + 1) * FANOUT)))
        go = ~last
        right.append((level, at[go], down[go] * FANOUT, b[go]))
        at, a, b = at[go], (up + ~whole)[go], down[go]
    for own in reversed(right):
        add(*own)
    return total


def _trailing(micros: int):
    def run(rows: pa.Table) -> pa.Table:
        """Rows of one key and one stretch of time, with those of the stretch before that frames reach back to."""
        v = rows["_value"].to_numpy()
        known = rows["_value"].is_valid().to_numpy()
        own = rows["_own"].to_numpy()
        v = np.where(known, v, 0.0)
        if rows["_us"].null_count:  # all are: rows without a time are each other's peers
            t = np.zeros(len(v), np.int64)
        else:
            t = rows["_us"].to_numpy()
        order = np.lexsort((v, t))
        t, v, known, own = t[order], v[order], known[order], own[order]
        end, begin = np.searchsorted(t, t[own], "right"), np.searchsorted(t, t[own] - micros, "left")
        total = _range_sums(v, rows["_before"][0].as_py() - int((~own).sum()), begin, end)
        seen = np.concatenate([[0], np.cumsum(known)])
        count = seen[end] - seen[begin]
        mean = pa.array(total / np.maximum(count, 1), mask=count == 0)
        out = rows.drop_columns(["_us", "_value", "_own", "_start", "_before"]).take(pa.array(order[own]))
        return out.append_column("n", pa.array(end - begin)).append_column("mean", mean)

    return run


def trailing(samples: DataFrame, seconds: int, ts: str = "ts", value: str = "value", by: str = "event_type") -> DataFrame:
    """Over the last `seconds` before each sample: number of samples and mean of their values, as columns n and mean. Batch form.

    Each key's time is cut into stretches of STRETCH windows, which tasks
    take one by one with the window before them; work and memory of a stretch
    grow with its rows, not with rows times those of a window.
    """
    from pyspark.sql import Window

    micros = seconds * 1_000_000
    us, width = F.unix_micros(F.col(ts).cast("timestamp")), STRETCH * micros
    kind = samples.withColumn("n", F.lit(0).cast("long")).withColumn("mean", F.lit(None).cast("double")).schema
    rows = samples.withColumns({"_us": us, "_value": F.col(value).cast("double")}).withColumn("_start", F.col("_us") - F.pmod("_us", F.lit(width)))
    sizes = rows.groupBy(F.col(by).alias("_by"), F.col("_start").alias("_at")).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("_by").orderBy(F.asc_nulls_last("_at")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_by", "_at", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    both = F.when(F.col("_us") - F.col("_start") >= width - micros, F.array(F.col("_start"), F.col("_start") + width)).otherwise(F.array("_start"))
    dealt = rows.withColumn("_in", F.explode(both)).withColumn("_own", F.col("_start").eqNullSafe(F.col("_in"))).drop("_start").withColumnRenamed("_in", "_start")
    j = dealt.join(sizes, F.col(by).eqNullSafe(F.col("_by")) & F.col("_start").eqNullSafe(F.col("_at"))).drop("_by", "_at")
    return j.groupBy(by, "_start").applyInArrow(_trailing(micros), kind)


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 day", ts: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """Event-time windows; in a stream, rows later than `late` are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def alerts(metrics: DataFrame, column: str, threshold: float) -> DataFrame:
    return metrics.filter(F.col(column) > threshold)


__all__ = ["alerts", "dedup", "index_stream", "stream_table", "trailing", "windowed"]
