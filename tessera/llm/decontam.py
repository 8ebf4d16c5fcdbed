"""Benchmark decontamination by Wu-Manber multi-pattern search.

A test item becomes windows of 10 consecutive words; each is a byte string
with a space before, between and after its words. Documents get the same form
and are searched for all windows at once. A table indexed by the hash of the
last bytes of the current block says how far the search may jump: a block that
ends in no window skips all positions that a window could end at. Where the
jump is 0, buckets by the same suffix hash hold the windows that can end here;
a bucket is sorted by a hash of the windows' common least length, so only those
that begin like the text are left, and their bytes are compared directly. Many
stretches of text are searched in lockstep by numpy, so the loop runs per jump,
not per byte or document.

A window is a place in the folded text of the test items, not a string of its
own, and all tables are arrays. Test items are read by the driver in blocks of
bounded size, an item larger than a block in pieces that overlap by 9 words.
All blocks are sent out, and one pass over the documents meets them all: a task
holds one block's tables at a time, and nothing is shuffled or written.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BYTE_VALUES, _powers, free_name, kept_in_worker, mix, same_bytes, slices, utf8

#: Bytes that separate words become a space, A-Z become a-z.
FOLD = bytes(32 if i < 0x30 or 0x3A <= i <= 0x40 or 0x5B <= i <= 0x60 or 0x7B <= i <= 0x7F else i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))
WINDOW = 10
#: Bytes of test text for each block. Of 8 MB (windows of 10 words of 6 letters) the tables took 0.6 GB while they were made and 80 MB when kept.
BLOCK_BYTES = 4 << 20
_TURN = np.uint64(0x9E3779B97F4A7C15)
_LANE = 1024  # bytes of text for each stretch
#: Bytes of text that are searched at a time; a longer text is searched alone.
SLICE_BYTES = (1 << 20) - (1 << 16)
#: Windows of fewer bytes are searched with the tables of their own length class.
CLASSES = (0, 4, 8, 16, 32, 64)
_SPAN = {0: 2, 4: 4, 8: 6, 16: 8, 32: 8, 64: 8}
_BASE = 0x9FB21C651E98DF25


class Sums:
    """Prefix sums of a text's polynomial hash, so that any stretch of it is hashed at once."""

    def __init__(self, raw: np.ndarray):
        self.up, self.down = _powers(_BASE, len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[raw] * self.up[: len(raw)], out=self.sums[1:])

    def __call__(self, at: np.ndarray, n) -> np.ndarray:
        return mix((self.sums[at + n] - self.sums[at]) * self.down[at] + np.asarray(n).astype(np.uint64))


class Tables:
    """Shift table and buckets of one length class: windows are places (start, length) in `text`."""

    def __init__(self, text: np.ndarray, start: np.ndarray, length: np.ndarray, span: int):
        self.span, self.m = span, int(length.min())
        width = self.m - span + 1  # positions of a block in the first m bytes
        self.bits = max(10, min(22, (8 * len(start) * width).bit_length()))
        self.shift = np.full(1 << self.bits, width, np.uint8 if width < 256 else np.uint16)
        raw = np.ndarray((len(text),), "<u8", np.concatenate((text, np.zeros(8, np.uint8))), strides=(1,))
        last = None
        for i in range(width):
            last = self.hash(raw[start + i])
            np.minimum.at(self.shift, last, width - 1 - i)
        head = Sums(text)(start, self.m)
        order = np.lexsort((head, last))
        self.start, self.length, self.head = start[order].astype(np.int32), length[order].astype(np.int32), head[order]
        self.bucket = np.searchsorted(last[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.order = order

    def hash(self, blocks: np.ndarray) -> np.ndarray:
        keep = np.uint64((1 << (8 * self.span)) - 1)
        return (((blocks & keep) * _TURN) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, raw: np.ndarray, sums: Sums, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all occurrences in raw, and the windows (their places in the tables)."""
        n, m = len(raw), self.m
        found_at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if n < m:
            return found_at[0], found[0]
        wide = np.ndarray((n,), "<u8", np.concatenate((raw, np.zeros(8, np.uint8))), strides=(1,))
        at = np.arange(0, n - m + 1, _LANE, dtype=np.int64)  # where a window would begin
        stop = np.minimum(at + _LANE, n - m + 1)
        shift, hits, size = self.shift, [], 0
        while len(at):
            h = self.hash(wide[at + (m - self.span)])
            s = shift[h]
            own = np.flatnonzero(s == 0)
            if len(own):
                hits.append((at[own], h[own]))
                size += len(own)
            at = at + np.maximum(s, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
            if hits and (size > 1 << 16 or not len(at)):
                p, k = self._compare(*map(np.concatenate, zip(*hits, strict=True)), n, sums, raw, text)
                found_at.append(p)
                found.append(k)
                hits, size = [], 0
        return np.concatenate(found_at), np.concatenate(found)

    def _compare(self, at, h, n, sums, raw, text):
        """Of the windows in the buckets, those that are in the text here."""
        low, high = self.bucket[h].astype(np.int64), self.bucket[h + 1].astype(np.int64)
        own = np.flatnonzero(low < high)
        at, low, high = at[own], low[own], high[own]
        head = sums(at, self.m)
        ends = []
        for right in (False, True):  # binary search in all buckets at once
            a, b = low.copy(), high.copy()
            while (a < b).any():
                mid = (a + b) // 2
                here = self.head[np.minimum(mid, len(self.head) - 1)]
                up = (a < b) & ((here <= head) if right else (here < head))
                a, b = np.where(up, mid + 1, a), np.where((a < b) & ~up, mid, b)
            ends.append(a)
        count = ends[1] - ends[0]
        p = np.repeat(at, count)
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ends[0], count)
        length = self.length[k].astype(np.int64)
        fit = np.flatnonzero(p + length <= n)
        p, k, length = p[fit], k[fit], length[fit]
        same = same_bytes(raw, p, text, self.start[k].astype(np.int64), length)
        return p[same], k[same]


def spaced(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' words with one space before, between and after them, one text after the other, and where each begins (n+1)."""
    parts = [b" " + b" ".join(t.split()) + b" " for t in texts]
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([*map(len, parts)], out=at[1:])
    return np.frombuffer(b"".join(parts), np.uint8), at


def _filled(kind, state: dict):
    """An object of a class from its attributes."""
    out = kind.__new__(kind)
    out.__dict__.update(state)
    return out


class Searcher:
    """The tables of a block of test items (item, folded text), and which items have each window."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.text, begin = spaced([t for _, t in items])
        names = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(names)}
        self.names = names
        starts, ends, owner = [], [], []
        for k, (item, _) in enumerate(items):
            gap = np.flatnonzero(self.text[begin[k] : begin[k + 1]] == 32) + begin[k]  # one more than words; two without words
            n = len(gap) - 1 if begin[k + 1] - begin[k] > 2 else 0
            if n:
                m = max(1, n - WINDOW + 1)
                starts.append(gap[:m])
                ends.append(gap[np.minimum(np.arange(m) + WINDOW, n)] + 1)
                owner.append(np.full(m, number[item]))
        self.classes = []
        if not starts:
            return
        start, end, owner = map(np.concatenate, (starts, ends, owner))
        length = end - start
        same = Sums(self.text)(start, length)
        # Equal windows once, with all their items; equal by bytes: the hash only brings them together.
        order = np.lexsort((owner, start, same))
        start, length, owner, same = start[order], length[order], owner[order], same[order]
        twin = np.zeros(len(start), bool)
        k = np.flatnonzero((same[1:] == same[:-1]) & (length[1:] == length[:-1]))
        twin[k + 1] = same_bytes(self.text, start[k], self.text, start[k + 1], length[k])
        first = np.flatnonzero(~twin)
        where = np.append(first, len(start))
        for low, high in zip(CLASSES, (*CLASSES[1:], 1 << 60), strict=True):
            own = np.flatnonzero((length[first] >= low) & (length[first] < high))
            if len(own):
                t = Tables(self.text, start[first[own]], length[first[own]], _SPAN[low])
                w = own[t.order]
                t.order = None
                n = where[w + 1] - where[w]
                t.owners_at = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                rows = np.arange(n.sum()) - np.repeat(t.owners_at[:-1], n) + np.repeat(where[w], n)
                t.owners = owner[rows].astype(np.int32)
                self.classes.append(t)

    def find(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all occurrences in the spaced text, and (start, item number) pairs."""
        sums = Sums(raw) if self.classes else None
        starts, ends, at, items = ([np.zeros(0, np.int64)] for _ in range(4))
        for t in self.classes:
            p, k = t.find(raw, sums, self.text)
            starts.append(p)
            ends.append(p + t.length[k])
            n = (t.owners_at[k + 1] - t.owners_at[k]).astype(np.int64)
            at.append(np.repeat(p, n))
            items.append(t.owners[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(t.owners_at[k].astype(np.int64), n)].astype(np.int64))
        return tuple(map(np.concatenate, (starts, ends, at, items)))


class _Sent:
    """A block's tables, sent to the executors as plain arrays, under a name that no other block has."""

    def __init__(self, of, name: str):
        self.of, self.name = of, name

    def load(self) -> Searcher:
        state = dict(self.of.value)
        self.of.__dict__.pop("_value", None)  # let go of what the worker would keep; it is read from its file again
        state["classes"] = [_filled(Tables, t) for t in state["classes"]]
        return _filled(Searcher, state)

    def kept(self) -> Searcher:
        """The tables, which the worker keeps for its later tasks, of one block only."""
        box = kept_in_worker("decontam", dict)
        if box.get("name") != self.name:
            box.clear()
            box.update(name=self.name, value=self.load())
        return box["value"]


def _search(blocks: list, text: str, name: str):
    """Adds to each row a struct `name` of word count, hit word intervals and item ids."""

    def run(batches):
        for batch in batches:
            buf, off = utf8(batch.column(batch.schema.get_field_index(text)))
            parts = [*slices(off, SLICE_BYTES)]
            hits: list[dict] = [defaultdict(list) for _ in parts]
            items: list[dict] = [defaultdict(set) for _ in parts]
            n_words: list[np.ndarray] = [np.zeros(0, np.int64)] * len(parts)
            for turn, block in enumerate(blocks or [None]):
                s = block and (block.kept() if len(blocks) == 1 else block.load())
                for k, (i, j) in enumerate(parts):
                    folded = buf[off[i] : off[j]].tobytes().translate(FOLD)
                    own = (off[i : j + 1] - off[i]).tolist()
                    raw, begin = spaced([folded[a:z] for a, z in zip(own[:-1], own[1:], strict=True)])
                    gap = np.flatnonzero(raw == 32)
                    if not turn:
                        n_words[k] = np.where(np.diff(begin) > 2, np.diff(np.searchsorted(gap, begin)) - 1, 0)
                    if not s:
                        continue
                    start, end, at, item = s.find(raw)
                    doc = np.searchsorted(begin, start, "right") - 1
                    base = np.searchsorted(gap, begin[doc])
                    for d, a, z in zip(doc.tolist(), (np.searchsorted(gap, start) - base).tolist(), (np.searchsorted(gap, end - 1) - base).tolist(), strict=True):
                        hits[k][d].append((a, z))
                    doc = np.searchsorted(begin, at, "right") - 1
                    for d, x in set(zip(doc.tolist(), item.tolist(), strict=True)):
                        items[k][d].add(s.names[x])
                del s
            n_hits, a, z, n_items, flat = [], [], [], [], []
            for (i, j), hit, item in zip(parts, hits, items, strict=True):
                for d in range(j - i):
                    spans = merged(hit[d]) if d in hit else []
                    n_hits.append(len(spans))
                    a += [x for x, _ in spans]
                    z += [x for _, x in spans]
                    own = sorted(item[d]) if d in item else []
                    n_items.append(len(own))
                    flat += own
            rows = len(batch)

            def lists(counts, values):
                return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts, dtype=np.int64))), pa.int32()), values)

            spans = pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "z"])
            words = pa.array(np.concatenate(n_words) if n_words else np.zeros(rows, np.int64), pa.int64())
            out = pa.StructArray.from_arrays([words, lists(n_hits, spans), lists(n_items, pa.array(flat, pa.string()))], names=["n_words", "hit", "items"])
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, name])

    return run


def merged(spans) -> list[tuple[int, int]]:
    """The union of half-open intervals, sorted and disjoint."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _blocks(benchmark: DataFrame, most: int, least_words: int):
    """Folded test items in blocks of at most `most` bytes; a longer item comes in pieces that share 9 words. The driver holds one block."""
    block, n = [], 0
    for x in benchmark.select(F.col("item_id").cast("string").alias("item"), "text").toLocalIterator():
        w = (x.text or "").encode().translate(FOLD).split()
        if len(w) < least_words:
            continue
        at = 0
        while True:
            size, z = 0, at
            while z < len(w) and (z - at < WINDOW or size + len(w[z]) + 1 <= most):
                size += len(w[z]) + 1
                z += 1
            if block and n + size > most:
                yield block
                block, n = [], 0
            block.append((x.item or "", b" ".join(w[at:z])))
            n += size
            if z >= len(w):
                break
            at = z - WINDOW + 1
    if block:
        yield block


def mark(docs: DataFrame, benchmark: DataFrame, name: str = "decon", block_bytes: int = BLOCK_BYTES, least_words: int = 1) -> DataFrame:
    """docs with all its columns and a struct `name`: n_words, hit (word intervals a to z), items (item ids).

    docs: text and anything else but a column `name`. benchmark: item_id, text.
    A document word is hit if an occurrence of any window covers it. Null or
    empty texts have no words; very long ones are searched whole; null and
    wordless items, and those of fewer than least_words, have no windows;
    repeated rows and items give what each gives alone; a null item_id reads as
    ''. With no item, nothing is hit. An empty table gives an empty table.
    """
    sc = docs.sparkSession.sparkContext
    blocks = []
    for block in _blocks(benchmark, block_bytes, least_words):
        s = Searcher(block)
        s.classes = [t.__dict__ for t in s.classes]
        blocks.append(_Sent(sc.broadcast(s.__dict__), uuid.uuid4().hex))  # the tables of at most block_bytes of text
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    kind = f"`{name}` struct<n_words: long, hit: array<struct<a: long, z: long>>, items: array<string>>"
    return docs.mapInArrow(_search(blocks, "text", name), f"{fields}, {kind}")


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (array of item ids, sorted as strings), contaminated; see mark()."""
    x = mark(docs.select("doc_id", "text"), benchmark, block_bytes=block_bytes).select("doc_id", "decon.*")
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda n, h: n + h["z"] - h["a"])
    return x.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, least_words: int = WINDOW) -> DataFrame:
    """docs with all their columns, without those that hold ten words in a row of a test item.

    Items of fewer than least_words words don't count here, as a word or two
    prove nothing; with 1 they count whole, as in mark(). Null and empty texts
    stay; repeated rows stay or go together. An empty table gives an empty one.
    """
    name = free_name(docs, "decon")
    return mark(docs, benchmark, name, least_words=least_words).filter(F.size(F.col(f"`{name}`.hit")) == 0).drop(name)


def op1(spark, sf_dir):
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def windows(text: str | None, n: int = WINDOW) -> set[bytes]:
    """The windows of a test item as strings, each with a space at both ends; for tests."""
    w = (text or "").encode().translate(FOLD).split()
    return {b" " + b" ".join(w[i : i + n]) + b" " for i in range(max(1, len(w) - n + 1))} if w else set()


def reference(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """Brute force for tests: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    want = {str(i): [w[1:-1].split(b" ") for w in windows(t)] for i, t in items}
    out = []
    for doc, text in docs:
        w = (text or "").encode().translate(FOLD).split()
        hit, own = set(), []
        for item, pats in want.items():
            spots = {(i, len(p)) for p in pats for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p}
            if spots:
                own.append(item)
                hit |= {k for i, n in spots for k in range(i, i + n)}
        out.append((doc, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return out


_W = r"list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"
ORACLE = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_W} AS w FROM benchmark),
d AS (SELECT doc_id, {_W} AS w FROM documents),
p AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k + 1 : k + 10], ' ') AS pat
      FROM (SELECT item, w, unnest(range(greatest(1, len(w) - 9))) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM p),
s AS (SELECT doc_id, n, k, array_to_string(w[k + 1 : k + n], ' ') AS pat
      FROM (SELECT doc_id, w, n.n AS n, unnest(range(len(w) - n.n + 1)) AS k FROM d, n WHERE len(w) >= n.n)),
h AS (SELECT s.doc_id, s.n, s.k, p.item FROM s JOIN p ON s.n = p.n AND s.pat = p.pat),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS k FROM h) GROUP BY doc_id),
g AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN g ON d.doc_id = g.doc_id
"""
