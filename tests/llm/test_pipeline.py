"""The corpus pipeline as a whole against plain Python, stage after stage."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from test_llm import brute_keep_one, brute_shards, brute_targets

import corpus_pipeline
from tessera.llm import decontam, quality
from tessera.llm.common import utf8


def plain_quality(field, text):
    """A document's score: forward and backward sums line by line, length weights, the curve."""
    x, _, _ = quality.line_features(*utf8(pa.array([text], pa.string())))
    emit = np.clip(((x - field.mean) / field.dev) @ field.w + field.bias, -30, 30)
    forward, scale = [], []
    for t, e in enumerate(emit):
        a = [math.exp(field.begin[s]) if not t else sum(forward[-1][r] * math.exp(field.trans[r][s]) for r in (0, 1)) for s in (0, 1)]
        a[1] *= math.exp(e)
        scale.append(sum(a))
        forward.append([v / sum(a) for v in a])
    back, good = [1.0, 1.0], [0.0] * len(emit)
    for t in range(len(emit) - 1, -1, -1):
        p = [forward[t][s] * back[s] for s in (0, 1)]
        good[t] = p[1] / sum(p)
        w = [back[0], back[1] * math.exp(emit[t])]
        back = [sum(math.exp(field.trans[r][s]) * w[s] for s in (0, 1)) / scale[t] for r in (0, 1)]
    weight = [len(line) + 1 for line in (text or "").split("\n")]
    p = min(max(sum(g * w for g, w in zip(good, weight)) / sum(weight), 1e-6), 1 - 1e-6)
    return 1 / (1 + math.exp(-(field.curve[0] * math.log(p / (1 - p)) + field.curve[1])))


def plain_mix(rows):
    """rows (doc_id, text, source), each as often as the mix takes it."""
    size = {d: len((t or "").encode().split()) for d, t, _ in rows}
    total = {}
    for d, _, s in rows:
        total[s] = total.get(s, 0) + size[d]
    target, out = brute_targets(total), []
    for s in total:
        budget = math.floor(target[s] + 0.5)
        passes = budget // total[s] if total[s] else 0
        left = budget - passes * total[s]
        for row in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()):
            n = size[row[0]]
            part = min(n, max(left, 0))
            left -= n
            out += [row] * ((passes + (part > 0 and 2 * part >= n)) if n else 0)
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The small tables with some more documents: near copies, passages of test items, odd texts and null sources."""
    src, out = "/root/testdata/sf0.001", tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{src}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    item = max((r.text for r in spark.read.parquet(f"{src}/benchmark.parquet").collect()), key=len)
    long = [r for r in rows if len((r[1] or "").split()) > 100][:6]
    more = [(10_000 + k, r[1] + " one more", r[2], r[3], 0) for k, r in enumerate(long[:3])]
    more += [(10_100 + k, r[1] + "\n" + " ".join(item.split()[:12]), r[2], r[3], 0) for k, r in enumerate(long[3:])]
    more += [(10_200, None, "en", "a", 0), (10_201, "", "en", None, 0), (10_202, long[0][1][::-1], "en", None, 0)]
    spark.createDataFrame(rows + more, docs.schema).repartition(3).write.parquet(f"{out}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{src}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return str(out)


def test_run_is_brute_force(spark, tables):
    got = corpus_pipeline.run(spark, tables).collect()
    docs, labels = (spark.read.parquet(f"{tables}/{n}.parquet") for n in ("documents", "labels"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    field = quality.fit(docs, labels, quality.F.lit(False))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    kept = [r for r in rows if plain_quality(field, r[1]) >= 0.5]
    assert 0 < len(kept) < len(rows)
    alone = {x[0] for x in brute_keep_one([r[:2] for r in kept])}
    single = [r for r in kept if r[0] in alone]
    assert len(single) < len(kept)
    bad = decontam.reference([r[:2] for r in single], [x for x in items if len((x[1] or "").encode().translate(decontam.FOLD).split()) >= 10])
    clean = [r for r, b in zip(single, bad) if not b[5]]
    assert len(clean) < len(single)
    mix = plain_mix(clean)
    last = {}  # copies of one record stay together, in the last of their shards
    for d, _, shard, _ in brute_shards([r[:2] for r in mix], 40):
        last[d] = max(shard, last.get(d, 0))
    text = {r[0]: r[1] for r in clean}
    assert len(text) == len(clean)
    assert sorted((r.doc_id, r.shard, r.text) for r in got) == sorted((d, last[d], text[d]) for d, _, _ in mix)
    assert got[0].__fields__ == [*docs.columns, "shard"]


def test_stages_keep_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumn("extra", quality.F.lit("x"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "source mixing", "sharding"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns + ["shard"] * (k == 4)
        assert stage(spark, docs.limit(0), tables).count() == 0
