"""Language-model scores by a hashed maximum-entropy model.

The next token's probability is that of its class times that of the token in
its class. The 512 most frequent training tokens stand in 16 classes of 32 by
falling frequency; all others in 16 open classes by their ending. Both factors
are softmaxes: class weights are hashed by the previous token, the one before
it (a skip feature) and the pair; weights within a class by the previous token
and by the skip. In an open class a token has (c+1) of the class's counts, c
its training count, and 1 is left for all tokens never seen.

Training: every task runs mini-batches of gradient steps over all its training
texts, from the same start (the unigram model); each weight row is then
averaged over tasks by how often they saw its feature. Rows are summed on the
executors, the driver gets the final table. The rows for contexts grow with the
root of the training tokens, as the number of different contexts does (a
doubling for each four times as many, see table_scale()), from 2**24 tokens up
to MOST_SCALE times; a training task then takes as many times more text, so
that what the tasks send stays in proportion to the input.

Counts are exact and cover all texts. The counts of the tokens that are most
frequent in all texts, held out or not (2**18 at most), go to every task; rarer
tokens travel to the task that has their count, as one row for each document
they are in, and come back as sums. So no task holds a vocabulary, and no hot
token travels at all.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Lookup, cut, mix, slices, utf8, word_hashes, words

CLASSES, PER_CLASS, OPEN = 16, 32, 16
#: Tokens whose counts every task has.
FREQUENT = 1 << 18
#: Rows of weights for the previous token, the skip, the pair; in each class, for the previous token and the skip. At scale 1, and the largest scale: 0.9 million rows, 117 MB.
SIZES, INNER = (4096, 4096, 16384), 1024
MOST_SCALE, SCALE_TOKENS = 16, 1 << 24
ALL = CLASSES + OPEN
BATCH, RATE = 16384, 0.3
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_END = np.uint64(0x5851F42D4C957F20)  # the end of a text
_NONE = np.uint64(0x2545F4914F6CDD10)  # before its start
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def table_scale(tokens: int) -> int:
    """How many times the rows at scale 1: the root of the training tokens over SCALE_TOKENS, a power of two."""
    return min(MOST_SCALE, 1 << max(0, round(np.log2(max(tokens, 1) / SCALE_TOKENS) / 2)))


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts as 64-bit values, and each text's first (n+1). The last four bits are the open class, by the last two bytes."""
    low = np.frombuffer(buf.tobytes().translate(_LOWER), np.uint8)
    starts, ends, first = words(low, off)
    h = word_hashes(low, starts, ends)
    tail = low[ends - 1].astype(np.uint64) * np.uint64(256) + np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    h = np.maximum(h & ~np.uint64(15), np.uint64(16)) | (mix(tail + _SALT[0]) & np.uint64(15))
    return np.insert(h, first[1:], _END), first + np.arange(len(first))


def _contexts(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two = np.empty_like(h), np.empty_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    begin = first[:-1]
    one[begin] = two[begin] = _NONE
    second = begin[np.diff(first) > 1] + 1
    two[second] = _NONE
    return one, two


class Model:
    """Vocabulary, start (unigram) weights, hashed weights and what the open classes hold."""

    def __init__(self, frequent: np.ndarray, times: np.ndarray, open_mass: np.ndarray, total: int, distinct: int):
        """frequent: tokens, the most frequent in training first; times: their counts there, which may be 0."""
        own = frequent[: CLASSES * PER_CLASS][times[: CLASSES * PER_CLASS] > 0]
        self.words = Lookup(own, np.arange(len(own), dtype=np.int32))
        counts = times[: len(own)].astype(float)
        self.closed = np.full((CLASSES, PER_CLASS), -1e4, np.float32)  # no such word
        mass = np.zeros(ALL)
        for k in range(CLASSES):
            c = counts[k * PER_CLASS : (k + 1) * PER_CLASS]
            self.closed[k, : len(c)] = np.log(c)
            mass[k] = c.sum()
        mass[CLASSES:] = open_mass
        self.mass = open_mass
        self.start = np.where(mass > 0, np.log(np.maximum(mass, 1)), -1e4).astype(np.float32)
        scale = table_scale(total)
        self.sizes, self.inner = [n * scale for n in SIZES], INNER * scale
        self.starts = np.concatenate(([0], np.cumsum([*self.sizes, *[CLASSES * self.inner] * 2])))
        self.weights = np.zeros((self.starts[-1], PER_CLASS), np.float32)
        self.total, self.distinct, self.scale = total, distinct, scale
        self.counts = Lookup(frequent, times)

    def rows(self, h: np.ndarray, first: np.ndarray):
        """Class, word in class (-1 in open classes) and feature rows of each token."""
        w = self.words.find(h, -1)
        cls = np.where(w >= 0, w // PER_CLASS, CLASSES + (h & np.uint64(15)).astype(np.int64)).astype(np.int64)
        one, two = _contexts(h, first)
        a, b = mix(one + _SALT[1]), mix(two + _SALT[2])
        pair = mix(a * _SALT[0] + b)
        feats = [(x & np.uint64(n - 1)).astype(np.int64) for x, n in zip((a, b, pair), self.sizes, strict=True)]
        inner = [(x >> np.uint64(32) & np.uint64(self.inner - 1)).astype(np.int64) for x in (a, b)]
        return cls, np.where(w >= 0, w % PER_CLASS, -1), feats, inner

    def log10(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 of each token's probability; in open classes only the class's, over what the class holds."""
        cls, word, feats, inner = self.rows(h, first)
        out = np.empty(len(h))
        t = [self.weights[a:b] for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)]
        for i in range(0, len(h), BATCH):
            s = slice(i, i + BATCH)
            z = t[0][feats[0][s]] + t[1][feats[1][s]] + t[2][feats[2][s]] + self.start
            out[s] = _log_softmax(z, cls[s])
            k = np.flatnonzero(word[s] >= 0) + i
            if len(k):
                c = cls[k]
                z = t[3][c * self.inner + inner[0][k]] + t[4][c * self.inner + inner[1][k]] + self.closed[c]
                out[k] += _log_softmax(z, word[k])
        out /= np.log(10)
        far = word < 0
        out[far] -= np.log10(self.mass)[cls[far] - CLASSES]
        return out


def _log_softmax(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    top = z.max(1)
    return (z[np.arange(len(z)), at] - top - np.log(np.exp(z - top[:, None]).sum(1))).astype(np.float64)


def _step(table: np.ndarray, past: np.ndarray, seen: np.ndarray, row: np.ndarray, grad: np.ndarray):
    """Adds the gradients of each row, scaled by the root of the row's past squares."""
    order = np.argsort(row.astype(np.uint16 if len(table) <= 1 << 16 else np.uint32), kind="stable")
    r = row[order]
    at = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    own, n = r[at], np.diff(np.append(at, len(r)))
    g = np.add.reduceat(grad[order], at, axis=0)
    past[own] += (g * g).mean(1)
    seen[own] += n
    table[own] += RATE * g / np.sqrt(1 + past[own])[:, None]


class Trainer:
    def __init__(self, model: Model):
        self.m = model
        self.w = model.weights.copy()
        self.past, self.seen = np.zeros(len(self.w), np.float32), np.zeros(len(self.w), np.int64)

    def learn(self, h: np.ndarray, first: np.ndarray):
        m = self.m
        cls, word, feats, inner = m.rows(h, first)
        part = [(self.w[a:b], self.past[a:b], self.seen[a:b]) for a, b in zip(m.starts[:-1], m.starts[1:], strict=True)]
        for i in range(0, len(h), BATCH):
            s = slice(i, i + BATCH)
            rows = [f[s] for f in feats]
            self._pull(part[:3], rows, m.start, cls[s])
            k = np.flatnonzero(word[s] >= 0) + i
            if len(k):
                c = cls[k] * m.inner
                self._pull(part[3:], [c + inner[0][k], c + inner[1][k]], m.closed[cls[k]], word[k])

    @staticmethod
    def _pull(parts, rows, base, want):
        z = base + sum(p[0][r] for p, r in zip(parts, rows, strict=True))
        z -= z.max(1)[:, None]
        np.exp(z, out=z)
        z /= -z.sum(1)[:, None]
        z[np.arange(len(z)), want] += 1
        for p, r in zip(parts, rows, strict=True):
            _step(*p, r, z)


def _held(ids: DataFrame | None = None):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _chunks(batches, most: int = 2 << 20):
    for batch in batches:
        buf, off = utf8(batch.column(0))
        held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, j in slices(off, most):
            yield batch.slice(i, j - i), held[i:j], *tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i])


def _count(batches):
    for _, held, h, first in _chunks(batches, 6 << 20):
        k, at, n = np.unique(h, return_inverse=True, return_counts=True)
        c = np.bincount(at[np.repeat(~held, np.diff(first))], minlength=len(k))
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64)), pa.array(n)], names=["h", "c", "m"])


def _train(model):
    def run(batches):
        t = Trainer(pickle.loads(model.value))
        for _, held, h, first in _chunks(batches):
            own = np.flatnonzero(~held)
            n = np.diff(first)
            if len(own):
                t.learn(h[np.repeat(~held, n)], np.concatenate(([0], np.cumsum(n[own]))))
        rows = np.flatnonzero(t.seen)
        for i in range(0, len(rows), 8192):
            r = rows[i : i + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(t.seen[r]), _binary(t.w[r])], names=["row", "n", "w"])

    return run


def _binary(m: np.ndarray) -> pa.Array:
    width = m.shape[1] * m.itemsize
    off = np.arange(len(m) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(m))])


def _floats(col: pa.Array, kind) -> np.ndarray:
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind).reshape(len(col), PER_CLASS)


def _sum(batches):
    """Weighted means of the rows that tasks have sent."""
    own, total, n = np.zeros(0, np.int64), np.zeros((0, PER_CLASS)), np.zeros(0, np.int64)
    for batch in batches:
        if len(batch):
            row, k, w = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _floats(batch.column(2), np.float32)
            row, k, w = np.concatenate((own, row)), np.concatenate((n, k)), np.concatenate((total, w * k[:, None]))
            order = np.argsort(row, kind="stable")
            row = row[order]
            at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            own, n, total = row[at], np.add.reduceat(k[order], at), np.add.reduceat(w[order], at, axis=0)
    if len(own):
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), _binary((total / n[:, None]).astype(np.float32))], names=["row", "w"])


def _score(model):
    """A row for each text, and (h not null) one for each rare token and text."""

    def run(batches):
        m = pickle.loads(model.value)
        nth, part = 0, None
        for batch, held, h, first in _chunks(batches):
            if part is None:
                part = batch.column(3)[0].as_py() << 40
            n = np.diff(first)
            ids = part + nth + np.arange(len(n))
            nth += len(n)
            begin = first[:-1]
            c = m.counts.find(h, -1)
            far = c < 0
            logs = np.log10(np.maximum(c, 0) + 1.0)
            logs[far] = 0
            model_log = m.log10(h, first)
            vocab = m.words.find(h, -1) >= 0
            base = np.add.reduceat(logs, begin)
            score = np.add.reduceat(model_log + np.where(vocab, 0.0, logs), begin)
            known = np.add.reduceat((c > 0).astype(np.int64), begin)
            k = len(n)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(ids), pa.nulls(k, pa.int32()), batch.column(2), pa.array(held), pa.array(n), pa.array(known), pa.array(base), pa.array(score)], names=_ROW)
            if far.any():
                doc = np.repeat(np.arange(k), n)[far]
                t = h[far]
                order = np.lexsort((doc, t))
                t, doc = t[order], doc[order]
                at = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (doc[1:] != doc[:-1]))))
                tf = np.diff(np.append(at, len(t))).astype(np.int32)
                d = doc[at]
                tf[held[d]] *= -1
                k = len(at)
                none = pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(t[at].view(np.int64)), pa.array(ids[d]), pa.array(tf), pa.nulls(k, batch.column(2).type), pa.nulls(k, pa.bool_()), none, none, pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64())], names=_ROW)

    return run


_ROW = ["h", "rid", "tf", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"]


def _gather(batches):
    """Rows sorted by h, to the texts' own rows and, for rare tokens, sums by text."""
    held_rows: list = []  # of tokens whose rows may go on in the next batch
    ids, known, logs, size = [], [], [], 0

    def settle(h, rid, tf):
        nonlocal size
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        c = np.repeat(np.add.reduceat(np.maximum(tf, 0).astype(np.int64), at), np.diff(np.append(at, len(h))))
        own = c > 0
        n = np.abs(tf[own]).astype(np.int64)
        ids.append(rid[own])
        known.append(n)
        logs.append(n * np.log10(c[own] + 1.0))
        size += len(n)

    def out():
        nonlocal size
        rid, at = np.unique(np.concatenate(ids), return_inverse=True)
        k = np.bincount(at, np.concatenate(known)).astype(np.int64)
        s = np.bincount(at, np.concatenate(logs))
        for x in (ids, known, logs):
            x.clear()
        size = 0
        n = len(rid)
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.nulls(n, kind), pa.nulls(n, pa.bool_()), pa.array(np.zeros(n, np.int64)), pa.array(k), pa.array(s), pa.array(s)], names=[_ROW[1], *_ROW[3:]])

    kind = pa.int64()
    for batch in batches:
        kind = batch.column(3).type
        own = batch.column(0).is_null()
        text = batch.filter(own)
        if len(text):
            yield text.select([_ROW[1], *_ROW[3:]])
        rare = batch.filter(own.cast(pa.int8()).to_numpy(zero_copy_only=False) == 0) if len(text) else batch
        if not len(rare):
            continue
        h, rid, tf = (rare.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if held_rows:
            h, rid, tf = (np.concatenate((a, b)) for a, b in zip(held_rows, (h, rid, tf), strict=True))
        last = int(np.flatnonzero(h == h[-1])[0])
        held_rows = [h[last:], rid[last:], tf[last:]]
        if last:
            settle(h[:last], rid[:last], tf[:last])
        if size > 1 << 20:
            yield out()
    if held_rows:
        settle(*held_rows)
    if size:
        yield out()


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and their training counts, the most frequent first: the vocabulary, and all above a level (in all texts) that at most FREQUENT exceed.

    The level comes from a histogram of the counts' logarithms (a few thousand
    rows), so no task sends more than its own share of the result.
    """
    level = F.floor(F.log2("m") * 64)
    many, least = 0, 1 << 30
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.level):
        many += r.n
        if many > FREQUENT:
            break
        least = r.level
    top = counts.orderBy(F.desc("c"), "h").limit(CLASSES * PER_CLASS).select("h", "c").toArrow()
    most = counts.filter(level >= least).select("h", "c").toArrow()  # at most FREQUENT rows
    h, c = (np.concatenate([t[n].to_numpy() for t in (top, most)]) for n in ("h", "c"))
    h, own = np.unique(h, return_index=True)
    c = c[own]
    order = np.lexsort((h, -c))
    return h[order].astype(np.int64).view(np.uint64), c[order].astype(np.int64)


def fit(docs: DataFrame) -> Model:
    """A model of the texts that aren't held out; docs: text, held."""
    sc = docs.sparkSession.sparkContext
    counts = docs.mapInArrow(_count, "h long, c long, m long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("m").alias("m"))
    counts = cut(counts)
    seen = F.col("c") > 0
    total = counts.agg(F.sum("c").alias("n"), F.count_if(seen).alias("v")).first()
    keys, times = _frequent(counts)
    mass = np.ones(OPEN)  # of tokens never seen
    for r in counts.filter(seen).groupBy(F.col("h").bitwiseAND(F.lit(OPEN - 1)).alias("k")).agg(F.sum(F.col("c") + 1).alias("s")).collect():
        mass[r.k] += r.s
    closed = np.flatnonzero(times[: CLASSES * PER_CLASS] > 0)
    np.subtract.at(mass, (keys[closed] & np.uint64(OPEN - 1)).astype(np.int64), times[closed] + 1)
    model = Model(keys, times, mass, total.n or 0, total.v or 0)
    sent = sc.broadcast(pickle_by_value(model))  # of a size that FREQUENT and MOST_SCALE bound
    texts = docs
    if model.scale > 1:  # fewer, larger tasks, as each sends a table
        texts = docs.coalesce(max(sc.defaultParallelism, docs.rdd.getNumPartitions() // model.scale))
    rows = texts.mapInArrow(_train(sent), "row int, n long, w binary").repartition("row").mapInArrow(_sum, "row int, w binary")
    for r in rows.toLocalIterator():
        model.weights[r.row] = np.frombuffer(r.w, np.float32)
    return model


def pickle_by_value(x) -> bytes:
    from pyspark import cloudpickle

    return cloudpickle.dumps(x)


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every text.

    docs: doc_id, text; other columns are ignored. Tokens are the A-Z
    lower-cased runs of anything but ASCII white space, then one end; null and
    empty texts have the end alone. Texts whose crc32(doc_id) mod 7 is 2 are
    held out; a null doc_id is not. Tokens are told apart by 60 bits of a
    hash: of V different ones, V*V/2**61 are expected to share their counts.
    Repeated rows count, and are scored, one by one. A very long text is
    scored whole, by its task. An empty table gives an empty table. Scores are
    log10 of probabilities. Training depends on how the table is split into
    tasks: the same files give the same scores, other splits nearly the same.
    """
    rows = docs.select("text", _held().alias("held"), "doc_id", F.spark_partition_id().cast("long").alias("part"))
    model = fit(rows.select("text", "held"))
    sent = docs.sparkSession.sparkContext.broadcast(pickle_by_value(model))
    kind = docs.schema["doc_id"].dataType.simpleString()
    cols = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double"
    dealt = rows.mapInArrow(_score(sent), f"h long, rid long, tf int, {cols}").repartition(F.coalesce("h", F.xxhash64("rid"))).sortWithinPartitions("h")
    sums = dealt.mapInArrow(_gather, f"rid long, {cols}").groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    start = float(np.log10(model.total + model.distinct + 1))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * start).alias("base_score"), "score")


def op7(spark, sf_dir):
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def reference_base(docs: list[tuple]) -> list[tuple]:
    """Plain counts for tests: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score)."""
    import math
    import zlib
    from collections import Counter

    split = [(d, zlib.crc32(str(d).encode()) % 7 == 2, [*(t or "").encode().translate(_LOWER).split(), None]) for d, t in docs]
    c = Counter(w for _, held, own in split if not held for w in own)
    n, v = sum(c.values()), len(c)
    return [(d, held, len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)) for d, held, own in split]
