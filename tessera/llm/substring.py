"""Substring dedup by recompression.

Every word becomes a 64-bit symbol. In each round a run of one symbol gets a
name, then each pair of a "left" symbol before a "right" one gets a name; the
side is a random bit of the symbol and the round. Names are hashes of what they
stand for, so all tasks give equal substrings the same names without asking,
and equal substrings have the same symbols inside, whatever stands around them.

For each symbol the words that its being there depends on are kept exactly:
its own and those of the neighbours that the rounds looked at. In a window, the
longest symbol whose words all lie in the window is its anchor; it is at the
same place in every occurrence. One row for each anchor, with a 64-bit hash of
each of its windows, is shuffled by the anchor's name. Names that one document
has reveal nothing and end there; within the shared ones, windows of equal
place and hash are repeats. Different windows may well share an anchor, so of
these only the 64 bits of the words tell them apart. Windows
without an anchor, such as those in long runs, are sent under their own hash.

A phrase of fewer words than a window that very many documents have, amid
different words, makes one name hot though nothing repeats. A first pass counts
the names of all texts; names with 1/HOT of all are dealt by the window's hash
too, so equal windows still meet, but not all the name's windows. A task keeps
each different window of its current name once, in sorted arrays that double
in size, so its work grows as the rows, times their logarithm.

A task first compares the windows of its own texts and sends each different
window once, so what is sent for a passage grows with the tasks, not with the
documents that have it, and a hot passage never gathers in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, mix, slices, span_hashes, utf8, word_hashes, words

#: Rounds of run and pair naming; a symbol is 4.4 words long on average after 5 and depends on about 23.
ROUNDS = 5
#: Bytes of text that a task compares at a time.
CHUNK = 2 << 20
#: A name with more than twice 1/HOT of all names is hot (fewer than HOT are), and is dealt to so many parts.
HOT, PARTS = 4096, 64
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def recompress(sym: np.ndarray, first: np.ndarray, rounds: int):
    """Names, starts, ends and the words that each depends on (from, to), after so many rounds.

    sym: symbols of all documents' words; first: the first word's number of
    each document (n+1). A name that depends on its document's end depends on
    one word more than there is.
    """
    n = len(sym)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low, high = first[:-1] - 1, first[1:] + 1  # beyond a document's ends
    s = np.arange(n)
    e = s + 1
    frm, to = s, e
    for turn in range(rounds):
        turn = np.uint64(2 * turn + 1)
        # Runs.
        new = np.ones(len(sym), bool)
        new[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(sym))
        count = end - at
        name = sym[at]
        many = count > 1
        name[many] = mix(name[many] * _K[0] + count[many].astype(np.uint64) * _K[1] + turn)
        d = doc[at]
        left = np.where((at > 0) & (doc[at - 1] == d), frm[at - 1], low[d])
        right = np.where((end < len(sym)) & (doc[np.minimum(end, len(sym) - 1)] == d), to[np.minimum(end, len(sym) - 1)], high[d])
        sym, s, e, frm, to, doc = name, s[at], e[end - 1], left, right, d
        # Pairs.
        side = mix(sym + turn * _K[2]) & np.uint64(1) > 0
        pair = np.zeros(len(sym), bool)
        pair[:-1] = side[:-1] & ~side[1:] & (doc[1:] == doc[:-1])
        second = np.zeros(len(sym), bool)
        second[1:] = pair[:-1]
        ahead = np.append(np.where(doc[1:] == doc[:-1], to[1:], high[doc[:-1]]), high[doc[-1:]]) if len(sym) else to
        back = np.append(low[doc[:1]], np.where(doc[1:] == doc[:-1], frm[:-1], low[doc[1:]])) if len(sym) else frm
        nxt = np.minimum(np.arange(len(sym)) + 1, max(0, len(sym) - 1))
        name = np.where(pair, mix(sym * _K[2] + mix(sym[nxt] + _K[3]) + turn), sym) if len(sym) else sym
        to2 = np.where(pair, to[nxt], np.where(side, ahead, to)) if len(sym) else to
        frm2 = np.where(pair | side, frm, back)
        e2 = np.where(pair, e[nxt], e) if len(sym) else e
        keep = ~second
        sym, s, e, frm, to, doc = name[keep], s[keep], e2[keep], frm2[keep], to2[keep], doc[keep]
    return sym, s, e, frm, to


def _least(rank: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each range low to high (not empty), the first place of its least rank."""
    n = high - low
    level = np.frexp(n.astype(np.float64))[1] - 1  # largest power of two within the range
    out = np.empty(len(n), np.int64)
    best = np.arange(len(rank))
    for k in range(int(level.max()) + 1 if len(n) else 0):
        if k:
            half = 1 << (k - 1)
            x, y = best[:-half], best[half:]
            best = np.where(rank[x] <= rank[y], x, y)
        own = np.flatnonzero(level == k)
        x, y = best[low[own]], best[high[own] - (1 << k)]
        out[own] = np.where(rank[x] <= rank[y], x, y)
    return out


def _packed(rows_of: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """A binary array whose i-th value has the values with rows_of == i (sorted)."""
    off = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(rows_of, minlength=n) * values.itemsize, out=off[1:])
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))])


_NAMES = ["sym", "doc", "pos", "delta", "wins"]


def _row(sym, doc, pos, delta, wins, null: bool) -> pa.RecordBatch:
    n = len(doc)
    sym = pa.nulls(n, pa.int64()) if null else pa.array(sym.view(np.int64))
    return pa.RecordBatch.from_arrays([sym, pa.array(doc), pa.array(pos, pa.int32()), pa.array(delta, pa.int32()), wins], names=_NAMES)


def _anchored(ids: np.ndarray, buf: np.ndarray, off: np.ndarray, width: int, rounds: int, hot: np.ndarray):
    """Rows of one chunk: those to be sent by anchor, and (sym null) windows known to be repeats."""
    starts, ends, first = words(buf, off)
    n = np.diff(first)
    keep = n >= width
    if not keep.any():
        return
    h = word_hashes(buf, starts, ends)
    # Every window of the chunk.
    m = np.where(keep, n - width + 1, 0)
    begin = np.concatenate(([0], np.cumsum(m)))
    p = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], m)
    doc = np.repeat(np.arange(len(n)), m)
    full = span_hashes(h, p, p + width, 0xA24BAED4963EE407)
    own = ids[doc]
    order = np.argsort(full)
    f = full[order]
    group = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
    least = np.minimum.reduceat(own[order], group)
    known = np.zeros(len(p), bool)
    known[order] = own[order] > np.repeat(least, np.diff(np.append(group, len(f))))
    pos = p - first[doc]
    if known.any():
        k = np.flatnonzero(known)
        d, row = np.unique(doc[k], return_inverse=True)
        zero = np.zeros(len(d), np.int32)
        yield _row(None, ids[d], zero, zero, _packed(row, pos[k].astype("<i4"), len(d)), True)
    sym, s, e, frm, to = recompress(mix(h), first, rounds)
    live = np.flatnonzero(~known)
    lp = p[live]
    low = np.cumsum(np.bincount(frm + 1, minlength=len(h) + 2))[lp]  # symbols that depend on a word before the window
    high = np.cumsum(np.bincount(to, minlength=len(h) + 2))[lp + width]  # and those that depend on none after it
    has = low < high
    a = np.zeros(len(live), np.int64)
    # The longest symbol, of these the one with the least hash, of these the first: what else the window is in doesn't matter.
    rank = (np.uint64(63) - np.minimum(e - s, 63).astype(np.uint64)) << np.uint64(58) | mix(sym) >> np.uint64(6)
    a[has] = _least(rank, low[has], high[has])
    w, a = live[has], a[has]
    if len(w):
        head = np.ones(len(w), bool)
        head[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1] + 1)
        at = np.flatnonzero(head)
        lead = w[at]
        warm = np.isin(sym[a[at]], hot)
        row = np.cumsum(head) - 1
        cold = ~warm[row]
        if cold.any():
            k = at[~warm]
            lead = w[k]
            yield _row(sym[a[k]], own[lead], pos[lead].astype(np.int32), (s[a[k]] - p[lead]).astype(np.int32), _packed(np.cumsum(~warm)[row[cold]] - 1, full[w[cold]].astype("<u8"), len(k)), False)
        # Of hot names each window goes alone, with a name of its own for its part; its place in the name stays the same.
        w, a = w[~cold], a[~cold]
        if len(w):
            part = mix(full[w] + _K[1]) % np.uint64(PARTS)
            yield _row(mix(sym[a] * _K[0] + part + _K[2]), own[w], pos[w].astype(np.int32), (s[a] - p[w]).astype(np.int32), _packed(np.arange(len(w)), full[w].astype("<u8"), len(w)), False)
    w = live[~has]
    if len(w):
        bits = full[w].astype("<u8")
        yield _row(mix(full[w] + _K[3]), own[w], pos[w].astype(np.int32), np.full(len(w), width, np.int32), _packed(np.arange(len(w)), bits, len(w)), False)


def _count_names(rounds: int):
    """Of each chunk, the names that 1/HOT of its names are, and how many; sym null has the number of all names."""

    def run(batches):
        total, names, times = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            buf, off = utf8(batch.column(0))
            for i, j in slices(off, CHUNK):
                part = buf[off[i] : off[j]]
                starts, ends, first = words(part, off[i : j + 1] - off[i])
                if not len(starts):
                    continue
                sym, *_ = recompress(mix(word_hashes(part, starts, ends)), first, rounds)
                total += len(sym)
                k, n = np.unique(sym, return_counts=True)
                own = n * HOT >= len(sym)
                names, at = np.unique(np.concatenate((names, k[own])), return_inverse=True)
                times = np.bincount(at, np.concatenate((times, n[own])), len(names)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([total], pa.int64())], names=["sym", "n"])
        if len(names):
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(times)], names=["sym", "n"])

    return run


def hot_names(docs: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Names that more than 2/HOT of all names are, at most HOT, sorted.

    A name with that share of all has half of it in the chunks where its own
    share is 1/HOT or more, and only those are counted; so none is missed, and
    fewer than HOT can reach it.
    """
    rows = docs.select("text").mapInArrow(_count_names(rounds), "sym long, n long").groupBy("sym").agg(F.sum("n").alias("n"))
    rows = cut(rows)
    total = rows.filter("sym is null").agg(F.max("n")).first()[0] or 0
    own = rows.filter(F.col("sym").isNotNull() & (F.col("n") * HOT >= total)).select("sym").collect()  # at most HOT rows
    return np.sort(np.array([r.sym for r in own], np.int64).view(np.uint64))


def _send(width: int, rounds: int, hot: np.ndarray):
    def run(batches):
        held, size = [], 0

        def out():
            t = pa.concat_tables(held).combine_chunks()
            buf, off = utf8(t["text"])
            ids = t["doc_id"].combine_chunks().to_numpy(zero_copy_only=False) if len(t) else np.zeros(0, np.int64)
            yield from _anchored(ids.astype(np.int64), buf, off, width, rounds, hot)

        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                held.append(pa.Table.from_batches([part]))
                size += len(utf8(part.column(1))[0])
                if size >= CHUNK:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return run


class _Seen:
    """The smallest document of each window of the current name: sorted arrays, each more than twice as long as the next."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def least(self, keys: np.ndarray) -> np.ndarray:
        """For each key its smallest document so far, the largest number there is for those not seen."""
        out = np.full(len(keys), np.iinfo(np.int64).max)
        for k, d in self.levels:
            at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
            out = np.where(k[at] == keys, np.minimum(out, d[at]), out)
        return out

    def add(self, keys: np.ndarray, docs: np.ndarray):
        """Distinct keys in ascending order that haven't been seen."""
        while self.levels and len(self.levels[-1][0]) <= 2 * len(keys):
            k, d = self.levels.pop()
            keys, docs = np.concatenate((k, keys)), np.concatenate((d, docs))
            order = np.argsort(keys, kind="stable")
            keys, docs = keys[order], docs[order]
        if len(keys):
            self.levels.append((keys, docs))


def _repeats(batches):
    """Rows sorted by sym and doc, to documents with the starts of windows that a smaller document has."""
    name, seen = None, _Seen()  # of the last name
    for batch in batches:
        if not len(batch):
            continue
        t = batch
        null = t.column(0).is_null().to_numpy(zero_copy_only=False)
        if null.any():
            yield pa.RecordBatch.from_arrays([t.column(1).filter(pa.array(null)), t.column(4).filter(pa.array(null))], names=["doc", "starts"])
            t = t.filter(pa.array(~null))
            if not len(t):
                continue
        sym, doc, pos, delta = (t.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        wins = t.column(4)
        off = np.frombuffer(wins.buffers()[1], np.int32)[wins.offset : wins.offset + len(wins) + 1].astype(np.int64)
        bits = np.frombuffer(wins.buffers()[2], "<u8", count=(off[-1] - off[0]) // 8, offset=off[0])
        off = (off - off[0]) // 8
        head = np.concatenate(([True], sym[1:] != sym[:-1]))
        g = np.cumsum(head) - 1
        at = np.flatnonzero(head)
        shared = doc[at] != doc[np.append(at[1:], len(doc)) - 1]  # sorted by doc within a name
        shared[-1] = True
        goes_on = name is not None and name == sym[0]
        shared[0] |= goes_on
        rows = np.flatnonzero(shared[g])
        n = np.diff(off)[rows]
        begin = np.cumsum(n) - n
        j = np.arange(n.sum()) - np.repeat(begin, n)
        row = np.repeat(rows, n)
        # A window: the place of the name in it, and the hash of its words; for one place all 64 bits of the hash count.
        key = mix(bits[off[row] + j] + mix((delta[row] - j).astype(np.uint64) + _K[0]))
        of, d, p = g[row], doc[row], pos[row] + j
        order = np.lexsort((d, key, of))
        k, o = key[order], of[order]
        group = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1]))))
        least = d[order][group]
        if goes_on:
            own = np.flatnonzero(o[group] == 0)
            least[own] = np.minimum(least[own], seen.least(k[group[own]]))
        again = np.zeros(len(k), bool)
        again[order] = d[order] > np.repeat(least, np.diff(np.append(group, len(k))))
        if not goes_on or g[-1]:
            seen = _Seen()
        name = sym[-1]
        own = np.flatnonzero(o[group] == g[-1])
        keys = k[group[own]]
        new = own[seen.least(keys) == np.iinfo(np.int64).max]
        seen.add(k[group[new]], least[new])
        if again.any():
            w = np.flatnonzero(again)
            w = w[np.argsort(d[w], kind="stable")]
            ids, row = np.unique(d[w], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), _packed(row, p[w].astype("<i4"), len(ids))], names=["doc", "starts"])


def _strip(width: int):
    def run(batches):
        for batch in batches:
            buf, off = utf8(batch.column(1))
            raw = buf.tobytes()
            n_words, n_removed, kept = [], [], []
            for i, found in enumerate(batch.column(2).to_pylist()):
                w = raw[off[i] : off[i + 1]].split()
                gone = 0
                if found:
                    at = np.frombuffer(b"".join(found), "<i4")
                    step = np.bincount(at, minlength=len(w) + 1) - np.bincount(np.minimum(at + width, len(w)), minlength=len(w) + 1)
                    stay = np.cumsum(step)[: len(w)] <= 0
                    gone = int(len(w) - stay.sum())
                    w = [w[k] for k in np.flatnonzero(stay).tolist()]
                n_words.append(len(w) + gone)
                n_removed.append(gone)
                kept.append(b" ".join(w))
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def substring_dedup(docs: DataFrame, width: int = 50, rounds: int = ROUNDS) -> DataFrame:
    """Remove each word that a window covers which also starts in a document with a smaller doc_id.

    docs: doc_id (integer, the name of one text), text; other columns are
    ignored. A window is `width` consecutive words, unchanged, split at ASCII
    white space. Windows are judged on the input. Returns doc_id, n_words,
    n_removed, kept (the words that stay, joined by one space). Texts of fewer
    words and null or empty ones lose nothing. Repeated rows have one doc_id,
    so none is smaller: each gets the same result. Rows with a null doc_id
    take no part and lose nothing. A very long text is compared whole; its task
    holds about 150 bytes for each of its words. An empty table gives an empty
    table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    named = docs.filter(F.col("doc_id").isNotNull())
    rows = named.mapInArrow(_send(width, rounds, hot_names(named, rounds)), "sym long, doc long, pos int, delta int, wins binary")
    # Known repeats (sym null) go along with the others and are dealt by document.
    dealt = rows.repartition(F.coalesce("sym", F.xxhash64("doc"))).sortWithinPartitions("sym", "doc")
    found = dealt.mapInArrow(_repeats, "doc long, starts binary").groupBy("doc").agg(F.collect_list("starts").alias("starts"))
    both = docs.join(found, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "starts")
    return both.mapInArrow(_strip(width), f"doc_id {kind}, n_words long, n_removed long, kept string")


def op8(spark, sf_dir):
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, k, array_to_string(w[k + 1 : k + 50], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS k FROM d WHERE len(w) >= 50)
), m AS (
  SELECT win, min(doc_id) AS least FROM s GROUP BY win HAVING min(doc_id) < max(doc_id)
), c AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS k FROM s JOIN m ON s.win = m.win WHERE s.doc_id > m.least
), x AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS k FROM d WHERE len(w) > 0
), y AS (
  SELECT x.doc_id, count(c.k) AS n_removed, string_agg(word, ' ' ORDER BY x.k) FILTER (WHERE c.k IS NULL) AS kept
  FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.k = c.k GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN y ON d.doc_id = y.doc_id
"""
