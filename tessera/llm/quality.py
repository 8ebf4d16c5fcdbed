"""Quality classifier: a linear-chain conditional random field over lines.

Every line of a text is good or bad. Its features are counts of byte classes,
words and repeats in the line itself and in the lines before and after it; the
field adds weights for what two neighbouring lines are.

Labels are known for documents, not for lines, so lines' labels are latent. A
first fit takes each line for itself (no transitions) and lets it learn its
document's label. Then rounds of EM: lines' labels are inferred by the whole
chain, under the one constraint that the length-weighted share of good lines
is at least SHARE in a good document and at most 1 - SHARE in a bad one
(posterior regularisation: the field that is nearest to the model among those
that meet the constraint); the chain with its transitions is fitted to those
marginals. A bad line in a good document may so stay bad, and the reverse.

A document's score is the mean of its lines' forward-backward marginals,
weighted by their length, put through a logistic curve that is fitted on the
same training rows.

Training sees at most SAMPLE_DOCS labelled documents with SAMPLE_LINES lines
together (those with the smallest hash of their doc_id; one that would pass
the bound is left out); the driver holds their line features only, some 64 MB.
Scoring is one pass over the texts without a shuffle; the model is a few
hundred numbers. A task holds the arrays of one Arrow batch's texts, so a very
long text costs its task about 400 bytes for each of its lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, slices, span_hashes, utf8, words

#: Labelled documents that the field learns from, and lines that they have together.
SAMPLE_DOCS, SAMPLE_LINES = 6000, 250_000
#: Gradient steps of the first fit, rounds of EM, gradient steps of each, and the share of good lines in a good document.
STEPS, ROUNDS, ROUND_STEPS, SHARE = 70, 4, 25, 0.6
_CLASSES = ("blank", "lower", "upper", "digit", "stop", "comma", "shout", "pipe", "sign", "mark", "quote", "lead", "tail")
_CLASS = np.full(256, _CLASSES.index("sign"), np.int64)
for _k, _own in {"blank": b" \t\r\x0b\x0c\n", "stop": b".", "comma": b",;:", "shout": b"!?", "pipe": b"|", "mark": b"*#$%&@^~+=<>", "quote": b"'\"()[]-"}.items():
    _CLASS[list(_own)] = _CLASSES.index(_k)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[0xC0:] = _CLASSES.index("lead")  # first byte of a character beyond ASCII
_CLASS[0x80:0xC0] = _CLASSES.index("tail")
#: Features of one line.
WIDTH = len(_CLASSES) - 1 + 8


def line_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line (with its neighbours'), code points of each line, lines of each document."""
    feeds = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate((off[:-1], feeds + 1)))
    ends = np.sort(np.concatenate((feeds, off[1:])))
    per_doc = np.diff(np.searchsorted(feeds, off)) + 1
    n = len(starts)
    row = np.repeat(np.arange(n), ends - starts)
    inside = np.ones(len(buf), bool)
    inside[feeds] = False
    k = len(_CLASSES)
    counts = np.bincount(row * k + _CLASS[buf[inside]], minlength=n * k).reshape(n, k).astype(np.float32)
    chars = counts.sum(1) - counts[:, -1]
    ws, _, _ = words(buf, off)
    at = np.searchsorted(starts, ws, "right") - 1
    n_words = np.bincount(at, minlength=n).astype(np.float32)
    capital = np.bincount(at, weights=(_CLASS[buf[ws]] == 2), minlength=n).astype(np.float32)
    share = counts[:, :-1] / np.maximum(chars, 1)[:, None]
    last = buf[np.maximum(ends - 1, 0)] if len(buf) else np.zeros(n, np.uint8)
    final = ((ends > starts) & ((last == 46) | (last == 33) | (last == 63))).astype(np.float32)
    h = span_hashes(buf.astype(np.uint64) + np.uint64(1), starts, ends, 0xD6E8FEB86659FD93)
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    order = np.lexsort((h, doc))
    same = np.zeros(n, np.float32)
    twin = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    same[order[1:]] = twin
    same[order[:-1]] = np.maximum(same[order[:-1]], twin)
    edge = np.concatenate(([0], np.cumsum(per_doc)))
    first = np.zeros(n, np.float32)
    first[edge[:-1]] = 1
    x = np.column_stack((share, np.log1p(chars), np.log1p(n_words), capital / np.maximum(n_words, 1), (chars - counts[:, 0]) / np.maximum(n_words, 1) / 8, final, same, first, (chars == 0).astype(np.float32))).astype(np.float32)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[edge[:-1]], after[edge[1:] - 1] = 0, 0
    return np.column_stack((x, before, after)), chars, per_doc


def _steps(per_doc: np.ndarray):
    """Documents by falling length, their first lines, and how many have a line t for each t."""
    order = np.argsort(-per_doc, kind="stable")
    start = (np.cumsum(per_doc) - per_doc)[order]
    length = per_doc[order]
    return start, length, np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")


def forward_backward(emit: np.ndarray, trans: np.ndarray, begin: np.ndarray, per_doc: np.ndarray, pairs: bool = False):
    """Marginals of "good" of each line, the documents' summed log normaliser, expected pairs and first states.

    emit: log-weight of good over bad. trans: 2x2 and begin: 2 log-weights.
    """
    start, length, active = _steps(per_doc)
    m = len(start)
    e = np.ones((len(emit), 2))
    e[:, 1] = np.exp(np.clip(emit, -30, 30))
    t_mat = np.exp(trans)
    alpha, norm = np.zeros((len(emit), 2)), np.zeros(len(emit))
    prev = None
    for t, k in enumerate(active):
        i = start[:k] + t
        a = e[i] * (np.exp(begin) if t == 0 else prev[:k] @ t_mat)
        s = a.sum(1)
        prev = a / s[:, None]
        alpha[i], norm[i] = prev, s
    beta = np.ones((m, 2))
    good = np.zeros(len(emit))
    both, firsts = np.zeros((2, 2)), np.zeros(2)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        i = start[:k] + t
        p = alpha[i] * beta[:k]
        p /= p.sum(1)[:, None]
        good[i] = p[:, 1]
        if t:
            right = e[i] * beta[:k] / norm[i][:, None]
            if pairs:
                both += (alpha[i - 1].T @ right) * t_mat
            beta[:k] = right @ t_mat.T
        elif pairs:
            firsts = p.sum(0)
    return good, float(np.log(norm).sum()) if len(norm) else 0.0, both, firsts


class Field:
    """Weights, and the logistic curve for documents."""

    def __init__(self, mean, dev, w, bias, trans, begin, curve):
        self.mean, self.dev, self.w, self.bias, self.trans, self.begin, self.curve = mean, dev, w, bias, trans, begin, curve

    def marginals(self, x: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        """The probability of each line that it is good."""
        emit = ((x - self.mean) / self.dev) @ self.w + self.bias
        return forward_backward(emit, self.trans, self.begin, per_doc)[0]

    def curved(self, p: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] * logit(p) + self.curve[1])))

    def scores(self, x: np.ndarray, chars: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        return self.curved(pooled(self.marginals(x, per_doc), chars, per_doc))


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def pooled(good: np.ndarray, chars: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """Mean marginal of each document, by length; an empty line weighs as one code point."""
    edge = np.cumsum(per_doc) - per_doc
    weight = chars.astype(np.float64) + 1
    return np.add.reduceat(good * weight, edge) / np.add.reduceat(weight, edge) if len(per_doc) else np.zeros(0)


class _Adam:
    """Weights (of features, bias, transitions, first states) and their running moments."""

    def __init__(self, z: np.ndarray, per_doc: np.ndarray, ridge: float):
        self.z, self.per_doc, self.ridge, self.d = z, per_doc, ridge, z.shape[1]
        self.theta = np.zeros(self.d + 7)
        self.first = np.cumsum(per_doc) - per_doc

    def parts(self):
        t, d = self.theta, self.d
        return self.z @ t[:d] + t[d], t[d + 1 : d + 5].reshape(2, 2), t[d + 5 :]

    def climb(self, target: np.ndarray, pairs: np.ndarray, firsts: np.ndarray, steps: int, chain: bool):
        """Ascends the likelihood of lines' labels that are known in expectation: of each line, of pairs and of first lines."""
        m1, m2 = np.zeros_like(self.theta), np.zeros_like(self.theta)
        size = len(self.per_doc)
        for step in range(1, steps + 1):
            good, _, both, begin = forward_backward(*self.parts(), self.per_doc, pairs=True)
            left = target - good
            grad = np.concatenate((self.z.T @ left, [left.sum()], (pairs - both).ravel(), firsts - begin)) / size - self.ridge * self.theta
            if not chain:
                grad[self.d + 1 :] = 0
            m1 = 0.9 * m1 + 0.1 * grad
            m2 = 0.999 * m2 + 0.001 * grad**2
            self.theta = self.theta + 0.1 * min(1, 2 * (1 - step / (steps + 1))) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)


def constrained(emit: np.ndarray, trans: np.ndarray, begin: np.ndarray, chars: np.ndarray, per_doc: np.ndarray, label: np.ndarray, share: float = SHARE):
    """forward_backward() of the field nearest to this one in which every document's pooled marginal agrees with its label.

    That field has, in each line, a document's multiplier times the line's
    weight added; the multiplier is found by bisection, 0 where nothing needs
    to be done.
    """
    first = np.cumsum(per_doc) - per_doc
    weight = chars.astype(np.float64) + 1
    weight = weight / np.repeat(np.add.reduceat(weight, first) / per_doc, per_doc)
    sign = np.where(label == 1, 1.0, -1.0)

    def short(p, label):  # how much a document's share is below what it should be, in its label's direction
        return share - np.where(label == 1, p, 1 - p)

    good = forward_backward(emit, trans, begin, per_doc)[0]
    low, high = np.zeros(len(label)), np.where(short(pooled(good, chars, per_doc), label) > 0, 64.0, 0.0)
    own = np.flatnonzero(high > 0)
    if len(own):
        lines = np.concatenate([np.arange(first[k], first[k] + per_doc[k]) for k in own])
        n = per_doc[own]
        for _ in range(12):
            mid = (low[own] + high[own]) / 2
            shift = np.repeat(sign[own] * mid, n) * weight[lines]
            g = forward_backward(emit[lines] + shift, trans, begin, n)[0]
            lacks = short(pooled(g, chars[lines], n), label[own]) > 0
            low[own], high[own] = np.where(lacks, mid, low[own]), np.where(lacks, high[own], mid)
    return forward_backward(emit + np.repeat(sign * high, per_doc) * weight, trans, begin, per_doc, pairs=True)


def train(x: np.ndarray, chars: np.ndarray, per_doc: np.ndarray, label: np.ndarray, steps: int = STEPS, ridge: float = 1e-3) -> Field:
    """A field from lines' features and documents' labels; one class alone gives its smoothed share."""
    d = 3 * WIDTH
    share = (label.sum() + 1) / (len(label) + 2)
    if len(label) == 0 or label.min() == label.max():
        return Field(np.zeros(d), np.ones(d), np.zeros(d), 0.0, np.zeros((2, 2)), np.zeros(2), (0.0, float(np.log(share / (1 - share)))))
    mean, dev = x.mean(0), x.std(0)
    dev = np.where(dev > 1e-6, dev, 1.0)
    fit = _Adam((x - mean) / dev, per_doc, ridge)
    none = np.zeros((2, 2)), np.zeros(2)
    fit.climb(np.repeat(label, per_doc).astype(np.float64), *none, steps, chain=False)
    for _ in range(ROUNDS):
        good, _, pairs, firsts = constrained(*fit.parts(), chars, per_doc, label)
        fit.climb(good, pairs, firsts, ROUND_STEPS, chain=True)
    w, bias, trans, begin = fit.theta[:d], fit.theta[d], fit.theta[d + 1 : d + 5].reshape(2, 2), fit.theta[d + 5 :]
    good, *_ = forward_backward(*fit.parts(), per_doc)
    s = logit(pooled(good, chars, per_doc))
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-(a * s + b)))
        g = np.array([((label - p) * s).sum() - 1e-2 * (a - 1), (label - p).sum()])
        v = p * (1 - p)
        hess = np.array([[(v * s * s).sum() + 1e-2, (v * s).sum()], [(v * s).sum(), v.sum() + 1e-2]])
        move = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = a + move[0], b + move[1]
    return Field(mean, dev, w, bias, trans, begin, (max(float(a), 1e-3), float(b)))


def _sampled(batches):
    for batch in batches:
        buf, off = utf8(batch.column(0))
        if len(off) < 2:
            continue
        x, chars, per_doc = line_features(buf, off)
        edge = np.concatenate(([0], np.cumsum(per_doc)))
        rows = [np.column_stack((chars[a:b], x[a:b])).astype("<f4").tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(rows, pa.binary())], names=["at", "label", "lines"])


def fit(docs: DataFrame, labels: DataFrame, held_out, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Field:
    """A field from labelled documents for which the column `held_out` is false, at most sample_docs with at most sample_lines lines.

    labels: doc_id, quality (0 or 1, others and null are left out; a doc_id
    with several rows has their rounded mean).
    """
    spark = docs.sparkSession
    own = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.round(F.avg("quality")).cast("long").alias("quality"))
    own = own.withColumn("at", F.xxhash64("doc_id")).orderBy("at", "doc_id").limit(sample_docs)
    texts = docs.select("doc_id", "text")
    n_lines = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")) + 1
    sizes = texts.join(F.broadcast(own), "doc_id").groupBy("at", "doc_id", "quality").agg(F.sum(n_lines).alias("n"))  # at most sample_docs rows
    chosen, left = [], sample_lines
    for r in sorted(sizes.collect(), key=lambda r: (r.at, r.doc_id)):
        if r.n <= left:
            chosen.append((r.doc_id, r.at, r.quality))
            left -= r.n
    few = spark.createDataFrame(chosen, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, at long, quality long")
    rows = texts.join(F.broadcast(few), "doc_id").select("text", "at", "quality")  # at most sample_docs rows
    got = sorted(rows.mapInArrow(_sampled, "at long, label long, lines binary").collect(), key=lambda r: (r.at, bytes(r.lines)))
    width = 3 * WIDTH + 1
    parts = [np.frombuffer(r.lines, "<f4").reshape(-1, width) for r in got]
    flat = np.concatenate(parts) if parts else np.zeros((0, width), np.float32)
    return train(flat[:, 1:].astype(np.float64), flat[:, 0], np.array([*map(len, parts)], np.int64), np.array([r.label for r in got], np.int64))


def _scored(field: Field, text: str, out: list[str], lines: bool):
    """Adds the score and, if asked for, the lines' marginals in the columns `out`; the column `text` goes unless it was asked to stay."""

    def run(batches):
        for batch in batches:
            buf, off = utf8(batch.column(batch.schema.get_field_index(text)))
            score, good, ends = np.zeros(len(off) - 1), [np.zeros(0)], [np.zeros(1, np.int64)]
            for i, j in slices(off, 1 << 19):
                x, chars, per_doc = line_features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                p = field.marginals(x, per_doc)
                score[i:j] = field.curved(pooled(p, chars, per_doc))
                if lines:
                    good.append(p)
                    ends.append(ends[-1][-1] + np.cumsum(per_doc))
            more = [pa.array(score)]
            if lines:
                more.append(pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(good))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *out])

    return run


def score(docs: DataFrame, field: Field, name: str = "score") -> DataFrame:
    """docs with all columns and a double `name`: near 1 is good. Null and empty texts are one empty line.

    docs may not have a column of that name; free_name() finds one.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_scored(field, "text", [name], False), f"{fields}, `{name}` double")


def line_labels(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score and `good`: for each line of the text, the probability that it is good (bad is below 0.5).

    docs: doc_id, text; other columns are ignored. A text has one line more
    than line feeds; null and empty texts have one. An empty table gives none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scored(field, "text", ["score", "good"], True), f"doc_id {kind}, text string, score double, good array<double>").drop("text")


def held_out_third():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def quality_scores(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    docs: doc_id, text; other columns are ignored and never an input. Rows
    whose crc32(doc_id) mod 3 is 1 are held out of training. A null doc_id is
    not held out and has no label. Equal texts, and repeated rows, have equal
    scores; null, empty and very long texts are scored like any other, whole.
    Without labels of both classes, every score is the smoothed share of label
    1. An empty table gives an empty table.
    """
    field = fit(docs, labels, held_out_third(), sample_docs)
    out = score(docs.select("doc_id", "text"), field)
    return out.select("doc_id", F.coalesce(held_out_third(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with all their columns, without those that score below 0.5; every labelled document may teach the field.

    Repeated rows and equal texts stay or go together. Null and empty texts
    are judged as one empty line. Rows with a null doc_id teach nothing and
    are judged like any other. An empty table, or one without labels of both
    classes of which most are good, loses nothing.
    """
    name = free_name(docs, "score")
    return score(docs, fit(docs, labels, F.lit(False)), name).filter(F.col(f"`{name}`") >= 0.5).drop(name)


def op6(spark, sf_dir):
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
