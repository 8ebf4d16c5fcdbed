"""Shared pieces of the corpus operators."""

from __future__ import annotations

import gc
import sys
import tempfile
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that the operators split and strip on.
BLANKS = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and Spark runs in one process (tests), a temporary
    folder is set. On a cluster without the setting this raises.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if own is None:
        own = sc.getCheckpointDir()
    if own is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it from there: the lineage ends, and lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Have the driver's JVM collect garbage, as Spark deletes the shuffle files and checkpoints of earlier rounds only then."""
    gc.collect()  # Python's ends of the tables first
    df.sparkSession._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it (case aside)."""
    own = {c.lower() for c in df.columns}
    while name.lower() in own:
        name = f"_{name}"
    return name


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; lower() does that for ASCII strings and is much faster than translate()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def word_count(c: Column) -> Column:
    """Number of runs of anything but ASCII white space, as long; 0 for null."""
    bare = F.btrim(F.coalesce(c, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[ \\t\\n\\x0B\\f\\r]+"))).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_in_worker(name: str, make):
    """A value that a Python worker makes once and keeps for its later tasks."""
    home = sys.modules.setdefault("_tessera_kept", types.ModuleType("_tessera_kept"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n+1, from 0) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def slices(offsets: np.ndarray, most: int):
    """Ranges of documents of at most so many bytes together, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def words(buf: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in buf) of the words of all documents, and the first word's number of each document (n+1)."""
    gap = np.ones(len(buf) + 2, bool)
    gap[1:-1] = blank[buf]
    begins = np.zeros(len(buf) + 1, bool)
    begins[offsets] = True
    inside = ~gap[1:-1]
    starts = np.flatnonzero(inside & (gap[:-2] | begins[:-1]))
    ends = np.flatnonzero(inside & (gap[2:] | begins[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def same_bytes(x: np.ndarray, at: np.ndarray, y: np.ndarray, to: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether x[at:at+n] equals y[to:to+n], byte for byte."""
    out = np.ones(len(at), bool)
    for i in range(0, len(at), 4096):
        k = slice(i, i + 4096)
        own = np.repeat(np.arange(len(n[k])), n[k])
        step = np.arange(len(own)) - np.repeat(np.cumsum(n[k]) - n[k], n[k])
        out[i + own[x[at[k][own] + step] != y[to[k][own] + step]]] = False
    return out


_ODD = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Powers beyond so many are made for one use and not kept by the worker (8 bytes each, twice).
_KEPT_POWERS = 1 << 20


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; the worker keeps them up to _KEPT_POWERS."""
    kept = kept_in_worker("powers", dict)
    own = kept.get(base, ((), ()))
    if len(own[0]) < n:
        m = (n + 65535) >> 16 << 16
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(m, np.uint64(b & _M64))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        own = tuple(out)
        if m <= _KEPT_POWERS:
            kept[base] = own
    up, down = own
    return up[:n], down[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit polynomial hash of values[start:end] for each pair, the length mixed in."""
    up, down = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_ODD))


#: A random 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(BYTE_VALUES[buf], starts, ends, 0xD6E8FEB86659FD93)


class Lookup:
    """A table from 64-bit keys (not 0) to numbers, by open addressing in numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.bits = np.uint64(64 - bits)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, values.dtype)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = keys[free]
            self.values[at[free]] = values[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_ODD)) >> self.bits).astype(np.int64)

    def find(self, keys: np.ndarray, other) -> np.ndarray:
        """The numbers of the keys; `other` for those that aren't in the table."""
        at = self._place(keys)
        out, left = np.full(len(keys), other, self.values.dtype), np.arange(len(keys))
        while len(left):
            key = self.keys[at[left]]
            same = key == keys[left]
            out[left[same]] = self.values[at[left[same]]]
            left = left[~same & (key != 0)]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        return out
