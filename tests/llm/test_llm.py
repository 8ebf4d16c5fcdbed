"""The corpus operators against brute force, SQL and hand-made cases.

Every operator sees nulls, empty and long texts, ties, repeated rows, empty
tables and extra columns whose names clash with its own.
"""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, lines, lm, media, mixing, quality, queries, sharding, simhash, substring, tokenfile
from tessera.llm.common import Lookup, mix, utf8, word_count, word_hashes, words

EXTRA = ["n_words", "score", "h", "size", "digest", "key", "copies", "part", "range", "kept", "at", "__x", "__text", "__size", "__id", "__key", "__digest", "__score", "__decon", "__copy", "__source", "__last"]


def docs_of(spark, rows, clash=True):
    """rows: doc_id, text[, source]; with columns that clash."""
    full = [(d, t, *(s or ["src"]), *([1] * len(EXTRA) if clash else [])) for d, t, *s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, source string" + "".join(f", {c} int" for c in EXTRA) * clash)


def empty(spark):
    return docs_of(spark, [])


def out_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(name, spark, sf_dir, duck):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from compare import assert_same

    assert_same(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLES[name])


# Shared pieces.


def test_words_and_lookup():
    col = pa.array([" a bb\tc ", None, "", "é x"])
    buf, off = utf8(col)
    s, e, first = words(buf, off)
    assert [bytes(buf[a:b]).decode() for a, b in zip(s, e)] == ["a", "bb", "c", "é", "x"] and first.tolist() == [0, 3, 3, 3, 5]
    h = word_hashes(buf, s, e)
    again = word_hashes(*(lambda b, o: (b, *words(b, o)[:2]))(*utf8(pa.array(["x bb é c a"]))))
    assert set(h.tolist()) == set(again.tolist()) and len(set(h.tolist())) == 5
    keys = mix(np.arange(1, 5001, dtype=np.uint64))
    t = Lookup(keys, np.arange(5000))
    assert (t.find(keys, -1) == np.arange(5000)).all() and (t.find(mix(keys), -1) == -1).all()


def test_word_count(spark):
    df = spark.createDataFrame([(None,), ("",), (" \t\n",), ("a  b\x0bc",)], "text string")
    assert [r[0] for r in df.select(word_count(F.col("text"))).collect()] == [0, 0, 0, 3]


# 1. Decontamination.

WORD = [f"w{i}" for i in range(40)]


def sample_items():
    long = " ".join(WORD[:25])
    return [(1, long), (2, " ".join(WORD[5:18])), (3, "Tiny Item"), (4, None), (5, "..."), (6, long), (7, "a"), (None, " ".join(WORD[10:21]))]


def sample_docs():
    r = random.Random(3)
    rows = [(None, "x"), (1, None), (2, ""), (3, "the TINY, item here"), (4, " ".join(WORD[:12]).upper()), (5, " ".join(WORD[3:12])), (6, "tinyitem"), (7, "b a\nb"), (8, "é " + " ".join(WORD[8:22]) + " é")]
    rows += [(i, " ".join(r.choice(WORD[:6] + ["tiny", "item"]) for _ in range(200))) for i in range(9, 14)]
    rows += [(14, " ".join(WORD[:25]) + " q " + " ".join(WORD[:25])), (14, " ".join(WORD[:25]) + " q " + " ".join(WORD[:25])), (15, "z " * 60000 + " ".join(WORD[:11]))]
    return rows


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, block):
    items = spark.createDataFrame(sample_items(), "item_id long, text string")
    got = decontam.contamination(docs_of(spark, sample_docs()), items, block)
    got = got.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), "contaminated")
    want = decontam.reference(sample_docs(), [("" if i is None else i, t) for i, t in sample_items()])
    assert out_of(got) == sorted(want, key=repr)
    assert sum(w[2] > 0 for w in want) >= 6


def test_decontamination_empty(spark):
    items = spark.createDataFrame(sample_items(), "item_id long, text string")
    assert decontam.contamination(empty(spark), items).count() == 0
    got = decontam.contamination(docs_of(spark, sample_docs()), items.limit(0)).collect()
    assert len(got) == len(sample_docs()) and not any(r.contaminated for r in got)
    kept = decontam.clean(docs_of(spark, sample_docs()), items)
    assert kept.columns == docs_of(spark, []).columns
    # Items of one or two words ("a", "Tiny Item") say nothing about a document; ten words in a row do.
    long = [(i, t) for i, t in sample_items() if len((t or "").split()) >= 10]
    bad = [r[5] for r in decontam.reference(sample_docs(), long)]
    assert out_of(kept.select("doc_id", "text")) == sorted([d for d, b in zip(sample_docs(), bad) if not b], key=repr)
    kept = decontam.clean(docs_of(spark, sample_docs()), items, 1)
    bad = [r[5] for r in decontam.reference(sample_docs(), sample_items())]
    assert out_of(kept.select("doc_id", "text")) == sorted([d for d, b in zip(sample_docs(), bad) if not b], key=repr)
    assert decontam.clean(empty(spark), items).count() == 0


def test_long_items_come_in_pieces(spark):
    """An item larger than a block loses no window."""
    r = random.Random(2)
    long = " ".join(r.choice(WORD) for _ in range(500))
    items = spark.createDataFrame([("x", long), ("y", long[40:900])], "item_id string, text string")
    w = long.split()
    rows = [(k, " ".join(w[k : k + 10])) for k in range(491)] + [(1000, " ".join(w[:9])), (1001, long)]
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontam.contamination(docs_of(spark, rows), items, 300).collect()}
    want = {x[0]: x[2] for x in decontam.reference(rows, [("x", long), ("y", long[40:900])])}
    assert {d: n for d, (n, _) in got.items()} == want and got[1001] == (500, ["x", "y"]) and got[1000] == (0, [])


def test_shift_table_skips():
    text, at = decontam.spaced([" ".join(WORD[:10]).encode()])
    t = decontam.Tables(text, np.array([0]), np.array([len(text)]), 8)
    assert t.shift.max() == t.m - 7 and t.shift.min() == 0
    # Windows that share their suffix and even their beginning are told apart by their bytes.
    many = [" ".join([*WORD[:9], f"z{i}"]).encode() for i in range(3000)]
    s = decontam.Searcher([(str(i), x) for i, x in enumerate(many)])
    raw, _ = decontam.spaced([b"q " + many[17] + b" q " + many[2999]])
    start, end, at, own = s.find(raw)
    assert sorted(s.names[i] for i in own) == ["17", "2999"] and sorted(bytes(raw[a:z]) for a, z in zip(start, end)) == sorted([b" " + many[17] + b" ", b" " + many[2999] + b" "])


# 2. SimHash.


def test_masks_cover():
    r = random.Random(1)
    for radius in (1, 2, 3, 4):
        masks = simhash.covering_masks([*range(64)], radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(2000):
            diff = sum(1 << p for p in r.sample(range(64), radius))
            assert any(m & diff == 0 for m in masks)


@pytest.fixture(scope="module")
def near_docs():
    r = random.Random(5)
    base = [r.choice("abcdefghij") + str(r.randrange(200)) for _ in range(400)]
    rows = [(None, "null id"), (1, None), (2, ""), (3, " \t "), (4, "one"), (5, "ONE"), (6, "one two")]
    for i in range(10, 90):  # near copies of one text
        own = list(base)
        for _ in range(i % 5):
            own[r.randrange(400)] = f"x{i}{r.randrange(9)}"
        rows.append((i, " ".join(own)))
    rows += [(i, " ".join(f"{i}{r.randrange(500)}" for _ in range(60))) for i in range(100, 120)]
    return rows + rows[10:14]


@pytest.mark.parametrize("cap", [simhash.CAP, 24])
def test_simhash(spark, near_docs, cap):
    named = [x for x in near_docs if x[0] is not None]
    got = simhash.near_duplicates(docs_of(spark, named), 3, 3, cap=cap)
    assert out_of(got) == sorted(simhash.reference(named), key=repr)
    with_null = simhash.near_duplicates(docs_of(spark, near_docs), 3, 3, cap=cap)
    assert with_null.count() == len(near_docs) and [r.component_id for r in with_null.filter("doc_id is null").collect()] == [None]


def test_simhash_empty_and_stage(spark, near_docs):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_one(docs_of(spark, near_docs))
    assert kept.columns == empty(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert None in ids and ids.count(10) == 1 and len([i for i in ids if i and 10 <= i < 90]) < 30 and set(range(100, 120)) <= set(ids)


def test_simhash_query_is_brute_force(spark, sf_dir, real):
    assert out_of(simhash.op2(spark, sf_dir)) == sorted(simhash.reference(real), key=repr)


def test_simhash_is_spark_xxhash64(spark, sf_dir):
    """The fingerprints' hashes against Spark's own XXH64, whose seed is 42."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    w = F.filter(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != "")
    rows = docs.select("doc_id", w.alias("w")).filter("size(w) >= 3").select("doc_id", F.posexplode("w").alias("p", "x"), "w").filter("p + 3 <= size(w)")
    rows = rows.select("doc_id", F.xxhash64(F.array_join(F.slice("w", F.col("p") + 1, 3), " ")).alias("h"))
    votes = rows.groupBy("doc_id").agg(F.count("*").alias("n"), *[F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)])
    want = {r.doc_id: sum(1 << b for b in range(64) if 2 * r[f"b{b}"] > r.n) for r in votes.collect()}
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(docs, 3).collect()}
    assert len(want) > 150 and all(got[d] == x for d, x in want.items())


def jaccard(x, y):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((x or "").lower().split(), (y or "").lower().split()))
    a, b = (s - {()} for s in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_keep_one(rows):
    """(doc_id, text) of the documents that stay, by all pairs."""
    rows = sorted(set(rows), key=lambda x: x[0])
    top = [*range(len(rows))]
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                a, b = i, j
                while top[a] != a:
                    a = top[a]
                while top[b] != b:
                    b = top[b]
                top[max(a, b)] = min(a, b)
    return [x for i, x in enumerate(rows) if top[i] == i]


def test_keep_one_of_one_id(spark):
    """Two texts with one doc_id are two documents; the same row twice is one."""
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(1, a), (1, b), (1, a), (2, b + " more"), (3, None), (4, ""), (4, None), (5, "z " * 30000), (6, "Z " * 29000)]
    got = [tuple(r) for r in simhash.keep_one(docs_of(spark, rows)).select("doc_id", "text").collect()]
    assert sorted(x[:2] for x in got if x[0] in (1, 2, 5, 6)) == sorted([(1, a), (1, b), (5, "z " * 30000)])
    assert [x[0] for x in got if x[0] in (3, 4)] == [3]


@pytest.mark.parametrize("hub_rows", [simhash.HUB_ROWS, 50])
def test_components_with_hubs(spark, hub_rows, monkeypatch):
    monkeypatch.setattr(simhash, "HUB_ROWS", hub_rows)
    pairs = [(0, i) for i in range(1, 4000)] + [(5000 + i, 3999 - i) for i in range(50)] + [(9000, 9001)]
    got = {r.v: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(4000)}, **{5000 + i: 0 for i in range(50)}, 9000: 9000, 9001: 9000}


def test_table_shape():
    """At every size some eight sets share a key, and a pair of 0.8 is in a table with odds of 0.99 at least."""
    for n in (0, 1, 1000, 10**5, 10**7, 10**9):
        bits, tables = simhash.table_shape(n)
        assert n / 2**bits < 9 and 1 - (1 - simhash.AGREE**bits) ** tables > 0.99


def test_keep_one_recall(spark):
    r = random.Random(9)
    rows, pairs = [], []
    for k in range(600):  # a text and a copy with some words changed in a row or apart
        own = [f"{k}w{r.randrange(10**6)}" for _ in range(r.choice([30, 60, 120, 400]))]
        other = list(own)
        for _ in range(r.randrange(1, max(2, len(own) // 40 + 1))):
            other[r.randrange(len(own))] = f"{k}x{r.randrange(10**6)}"
        if k % 2:
            del other[len(own) - r.randrange(len(own) // 4) :]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
        pairs.append((2 * k + 1, jaccard(rows[-2][1], rows[-1][1])))
    kept = {x.doc_id for x in simhash.keep_one(docs_of(spark, rows)).collect()}
    assert {2 * k for k in range(600)} <= kept
    assert all(i in kept for i, j in pairs if j < 0.8)
    for low, high, recall in ((0.8, 0.85, 0.95), (0.85, 0.9, 0.98), (0.9, 0.95, 0.98)):
        own = [i for i, j in pairs if low <= j < high]
        assert len(own) > 20 and sum(i not in kept for i in own) >= recall * len(own)


def test_near_but_not_near_enough(spark, monkeypatch):
    """Copies of one text that differ from each other by more than they may, a few of them linked: nothing is linked or lost, and few rows leave a task."""
    made = []
    whole = simhash._set_links

    def counted(t):
        for x in whole(t):
            made.append(len(x))
            yield x

    r = random.Random(12)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for d in range(160):
        own = list(base)
        for at in r.sample(range(300), r.choice([2, 12, 14, 16, 18])):
            own[at] = f"{d}x{at}"
        rows.append((d, " ".join(own)))
    assert sorted(x.doc_id for x in simhash.keep_one(docs_of(spark, rows)).collect()) == [d for d, _ in brute_keep_one(rows)]
    sets = [np.arange(100, dtype=np.uint64), np.arange(5, 100, dtype=np.uint64), np.arange(50, 150, dtype=np.uint64), np.arange(0, 0, dtype=np.uint64)]
    cols = [pa.array([k for k in (1, 2) for _ in sets]), pa.array([*range(4)] * 2), pa.array([*range(4)] * 2), pa.array([x.tolist() for x in sets] * 2, pa.list_(pa.int64()))]
    for x in counted(pa.table(cols, names=["key", "node", "comp", "own"])):
        assert x.to_pydict() == {"a": [0, 0], "b": [1, 1]}
    assert made == [2]


def test_rows_of_a_key_stay_together():
    r = random.Random(1)
    keys = sorted(r.choice(range(30)) for _ in range(500))
    t = pa.table([pa.array(keys), pa.array([*range(500)])], names=["key", "x"])
    for size in (1, 3, 40, 1000):
        seen, rows = [], []

        def settle(part):
            seen.append(set(part["key"].to_pylist()))
            rows.extend(part["x"].to_pylist())
            return []

        list(simhash._by_key(settle)(t.to_batches(max_chunksize=size)))
        assert rows == [*range(500)] and sum(map(len, seen)) == len(set(keys))


def test_keep_one_group(spark, near_docs):
    ids = [x.doc_id for x in simhash.keep_one(docs_of(spark, near_docs)).collect()]
    assert [i for i in ids if i and 10 <= i < 90] == [10] and len([i for i in ids if i in (1, 2, 3)]) == 1 and len([i for i in ids if i in (4, 5)]) == 1


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.v: r.root for r in simhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert simhash.components(links.limit(0)).count() == 0


# 3. Sharding.


def shard_case(spark, rows, shards=4):
    out, firsts = sharding.shard_records(docs_of(spark, rows), shards)
    got = out.collect()
    total = sum(r.size for r in got)
    for s in range(shards):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / shards) <= max(r.size for r in got)
    assert len(firsts) <= shards
    return got


def test_sharding(spark, real):
    got = shard_case(spark, real)
    text = dict(real)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
    odd = [(None, None), (None, "x"), *[(i, "same text " * 20) for i in range(60)], *[(7, "again")] * 40, (8, ""), (9, "é" * 3000)]
    shard_case(spark, odd)
    shard_case(spark, [(1, "a")], 4)


def test_sharding_empty_and_stage(spark, real):
    out, firsts = sharding.shard_records(empty(spark), 4)
    assert out.count() == 0 and firsts == []
    assert sharding.write_order(empty(spark), 4).count() == 0
    odd = [(None, None), (None, "x"), (None, "x"), *[(5000 + i, "same text " * 20) for i in range(300)], *[(7777, "again")] * 40, (8888, ""), (9999, "é" * 100_000)]
    rows = real + odd
    placed = sorted((r.doc_id is not None, r.doc_id, r.text_crc32, r.shard) for r in sharding.shard_records(docs_of(spark, rows), 4)[0].collect() if r.doc_id is not None)
    dealt = sharding.write_order(docs_of(spark, rows), 4)
    got = dealt.collect()
    assert dealt.columns == [*empty(spark).columns, "shard"] and len(got) == len(rows)
    assert sorted((True, r.doc_id, zlib.crc32((r.text or "").encode()), r.shard) for r in got if r.doc_id is not None) == placed
    # Shards, and slots within them, come in order.
    keys = [(r.shard, hashlib.md5((r.text or "").encode()).hexdigest()[:16], -(1 << 63) if r.doc_id is None else r.doc_id) for r in got]
    assert keys == sorted(keys)
    clash = docs_of(spark, rows).withColumn("shard", F.lit("old")).withColumn("id", F.lit(3))
    assert sharding.write_order(clash, 4).columns == [*empty(spark).columns, "id", "shard"]


def brute_shards(rows, shards):
    """(doc_id, size, shard, slot) by one sort of all records."""
    own = sorted((hashlib.md5((t or "").encode()).hexdigest()[:16], d is not None, d, len((t or "").encode()) + 16) for d, t in rows)
    total, at, out, slots = sum(x[3] for x in own), 0, [], {}
    for _, _, d, size in own:
        s = min((2 * at + size) * shards // (2 * total), shards - 1)
        out.append((d, size, s, slots.get(s, 0)))
        slots[s] = slots.get(s, 0) + 1
        at += size
    return out


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_sharding_is_one_sort(spark, ranges, monkeypatch):
    monkeypatch.setattr(sharding, "RANGES_PER_SHARD", ranges)
    rows = [(i, f"t{i % 7}" * (i % 50)) for i in range(900)] + [(i, "hot " * 9) for i in range(900, 1500)]
    got = sharding.shard_records(docs_of(spark, rows), 7)[0].select("doc_id", "size", "shard", "slot")
    assert out_of(got) == sorted(brute_shards(rows, 7), key=repr)


def test_overfull_ranges_are_subdivided(spark):
    rows = sharding.record_sizes(docs_of(spark, [(i, "hot") for i in range(500)] + [(i, f"t{i}") for i in range(500, 600)]))
    cuts, sums = sharding.splitters(rows, 16)
    fair = sum(b for b, _ in sums.values()) / 16
    assert max(b for b, _ in sums.values()) <= 2 * fair and sum(n for _, n in sums.values()) == 600


# 4. Media.


def test_png_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 191, 192, 193, 5000):
        data = r.integers(0, 256, n, dtype=np.uint8).tobytes()
        p = media.pad(data)
        assert len(p) % 192 == 0 and p and media.read_png(media.write_png(p)) == p and p.startswith(data)
    with pytest.raises(ValueError):
        media.read_png(b"x")
    broken = bytearray(media.write_png(media.pad(b"abc")))
    broken[45] ^= 1
    with pytest.raises(ValueError):
        media.read_png(bytes(broken))


def filtered_png(payload):
    """A PNG that uses all row filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, 192).astype(int)
    out = b""
    for r, x in enumerate(rows):
        kind = r % 5
        up = rows[r - 1] if r else np.zeros(192, int)
        a = np.concatenate(([0] * 3, x[:-3]))
        c = np.concatenate(([0] * 3, up[:-3]))
        q = a + up - c
        paeth = np.where((abs(q - a) <= abs(q - up)) & (abs(q - a) <= abs(q - c)), a, np.where(abs(q - up) <= abs(q - c), up, c))
        guess = [np.zeros(192, int), a, up, (a + up) // 2, paeth][kind]
        out += bytes([kind]) + ((x - guess) % 256).astype(np.uint8).tobytes()
    plain = media.write_png(payload)
    head = plain[: plain.index(b"IDAT") - 4]
    return head + media._chunk(b"IDAT", zlib.compress(out)) + media._chunk(b"IEND", b"")


def test_png_filters():
    data = np.random.default_rng(1).integers(0, 256, 192 * 11, dtype=np.uint8).tobytes()
    assert media.read_png(filtered_png(data)) == data


def test_parse_sequence():
    html = "<head><title>no</title></head><p>One <b>two</b></p><figure><img src='a' alt='alt'><figcaption>Cap tion</figcaption></figure>tail<img src=b alt='B'><script>x</script><video src='v'></video><p>"
    got = [(x["text"], x["media"], x["caption"]) for x in media.parse_sequence(html)]
    assert got == [("One two", None, None), (None, "a", "Cap tion"), ("tail", None, None), (None, "b", "B"), (None, "v", None)]
    assert media.parse_sequence(None) == media.parse_sequence("") == []
    assert [x["text"] for x in media.parse_sequence("<p>a<figcaption>left open")] == ["a", "left open"]


def test_sequences_resolve(spark):
    d = hashlib.sha256(b"pic").hexdigest()
    pages = spark.createDataFrame([(1, f"<p>x</p><img src='sha256:{d}' alt='c'><p>y</p><img src='http://z/z.png'>"), (2, None), (3, f"<img src='sha256:{'0' * 64}'>")], "page_id long, html string")
    store = spark.createDataFrame([(d, base64.b64decode("AAEC"))] * 3, "digest string, media binary")
    rows = media.resolve(media.sequences(pages), store, ["media"])
    got = {r.id: r["items"] for r in media.interleaved(rows).collect()}
    assert [(i.pos, i.text, i.caption, i.found and i.found.media and bytes(i.found.media)) for i in got[1]] == [(0, "x", None, None), (1, None, "c", b"\x00\x01\x02"), (2, "y", None, None), (3, None, None, None)]
    assert 2 not in got and got[3][0].found.media is None
    assert media.resolve(media.sequences(pages.limit(0)), store.limit(0), ["media"]).count() == 0


def test_pages_hold_the_text(spark):
    """A document's sequence is its text, line by line, with the figure after the first."""
    texts = ["one\ntwo & three <b>not bold</b>\n\nfour", "", None, "single", "\nled by a feed", "a &amp; b &lt; <!-- c --> <script>d", "</p><p>\n'\"\x00 é"]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {r.id: r["items"] for r in media.sequences(media.text_pages(docs_of(spark, rows)), "doc_id").collect()}
    for k, t in rows:
        items, raw = got[k], (t or "")
        words = [" ".join(x.split()) for x in raw.split("\n")]
        assert [i.text for i in items if i.text] == [w for w in words if w]
        where = [i.pos for i in items if i.media]
        assert where == [1 if words[0] else 0] and items[where[0]].media == "sha256:" + hashlib.sha256(raw.encode()).hexdigest()
        assert items[where[0]].caption and [i.pos for i in items] == list(range(len(items)))


def plain_png(data):
    """The samples and text chunks of a PNG without row filters, by another reader than the operator's."""
    at, parts = 8, {}
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        parts.setdefault(data[at + 4 : at + 8], []).append(data[at + 8 : at + 8 + n])
        at += 12 + n
    width, height = (int.from_bytes(parts[b"IHDR"][0][i : i + 4], "big") for i in (0, 4))
    raw = zlib.decompress(b"".join(parts[b"IDAT"]))
    assert len(raw) == height * (3 * width + 1) and all(raw[r * (3 * width + 1)] == 0 for r in range(height))
    return b"".join(raw[r * (3 * width + 1) + 1 : (r + 1) * (3 * width + 1)] for r in range(height)), parts.get(b"tEXt"), (width, height)


def plain_feature(p):
    """The feature string by plain arithmetic."""
    import json
    import math
    from collections import Counter

    mean = [sum(p[c::3]) / len(p[c::3]) for c in range(3)]
    std = [math.sqrt(sum((x - m) ** 2 for x in p[c::3]) / len(p[c::3])) for c, m in enumerate(mean)]
    entropy = -sum(n / len(p) * math.log2(n / len(p)) for n in Counter(p).values())
    q, r = divmod(len(p), 64)
    cells, at = [], 0
    for i in range(64):
        n = q + (i < r)
        cells.append(sum(p[at : at + n]) / n)
        at += n
    bits = sum(1 << (63 - i) for i, c in enumerate(cells) if c > sum(cells) / 64)
    return json.loads(json.dumps({"w": 64, "h": len(p) // 192, "mean": mean, "std": std, "entropy": entropy, "ahash": f"{bits:016x}"}))


def test_media_query(spark, sf_dir, real):
    import json

    got = {r.doc_id: r for r in media.op4(spark, sf_dir).collect()}
    stored = {r.digest: bytes(r.media) for r in media.text_store(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert len(got) == len(real)
    for d, t in real:
        raw, r = (t or "").encode(), got[d]
        p = raw + b" " * (192 - len(raw) % 192 if len(raw) % 192 or not raw else 0)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        own = stored[hashlib.sha256(raw).hexdigest()]
        assert plain_png(own) == (p, [b"Length\0%d" % len(raw)], (64, len(p) // 192))
        assert (r.media_bytes, r.media_sha256) == (len(own), hashlib.sha256(own).hexdigest())
        want, have = plain_feature(p), json.loads(r.feature)
        assert all(have[k] == want[k] for k in ("w", "h")) and have["entropy"] == pytest.approx(want["entropy"], abs=1e-4)
        assert have["mean"] == pytest.approx(want["mean"], abs=1e-4) and have["std"] == pytest.approx(want["std"], abs=1e-4)
        assert (int(have["ahash"], 16) ^ int(want["ahash"], 16)).bit_count() <= 1  # a cell that equals the mean, by rounding


def test_media_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, "a"), (2, "a"), (3, "z" * 200_000 + "\n<>&")]
    got = sorted(media.text_media(docs_of(spark, rows)).select("doc_id", "n_bytes", "payload_bytes").collect(), key=repr)
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 0, 192), (1, 0, 192), (2, 1, 192), (2, 1, 192), (3, 200_004, 200_064)], key=repr)
    assert media.text_media(empty(spark)).count() == 0 and media.text_store(empty(spark)).count() == 0


# 5. Token files.


def test_pack_round_trip():
    r = np.random.default_rng(2)
    for v in ([], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], r.integers(0, 2**32, 1001), r.integers(0, 300, 1003)):
        v = np.array(v, np.uint32)
        control, data = tokenfile.pack(v)
        assert len(control) == -(-len(v) // 4) and (tokenfile.unpack(control, data, len(v)) == v).all()
    ids, n = np.array([5, 5, 9, 1, 1], np.uint32), np.array([3, 1, 1, 0])
    got = tokenfile.read_segment(tokenfile.write_segment(ids, n))
    assert (got[0] == ids).all() and (got[1] == n).all()
    with pytest.raises(ValueError):
        tokenfile.read_segment(b"nothing here")


def test_token_query(spark, sf_dir, real):
    assert out_of(tokenfile.op5(spark, sf_dir)) == sorted(tokenfile.reference(real, tokenfile.vocabulary()), key=repr)


ODD_TEXTS = ["", " ", "Don't stop it's 10,000! é", "é Å K", "a" * 5000, "ΟΔΟΣ ΣΑΣ", "tab\there\x0bnow", "x y z", "<|endoftext|> and <|ENDOFTEXT|>", "\U0001f600\U0001f601 ok", "İI ı", "they'll 'tis 's", "a|b||c", "日本語 テキスト", "q!?q"]


def test_encoder_is_the_library(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(99, None)]
    out = str(tmp_path / "t")
    tokenfile.write_tokens(docs_of(spark, rows), out, tokenfile.vocabulary(), 40)
    assert out_of(tokenfile.read_index(spark, out)) == sorted(tokenfile.reference(rows, tokenfile.vocabulary()), key=repr)
    enc = tokenfile.Encoder(tokenfile.vocabulary(), 8)  # a table that fills up at once
    for _ in range(3):
        for t in ODD_TEXTS:
            ids, n = enc.encode(*utf8(pa.array([t, t])))
            want = [*enc.tok.encode(t, add_special_tokens=False).ids, 1]
            assert ids.tolist() == want * 2 and n.tolist() == [len(want)] * 2


def test_pieces_of_one_hash(monkeypatch):
    """Pieces that share a hash are told apart by their bytes."""
    monkeypatch.setattr(tokenfile, "word_hashes", lambda buf, a, b: np.full(len(a), 5, np.uint64))
    enc = tokenfile.Encoder(tokenfile.vocabulary())
    for t in ["one two", "two one", "six"]:
        assert enc.encode(*utf8(pa.array([t])))[0].tolist() == [*enc.tok.encode(t, add_special_tokens=False).ids, 1]


def test_other_vocabulary_files():
    """A file that keeps capitals and white space isn't cut by rules that don't fit it."""
    enc = tokenfile.Encoder(tokenfile.vocabulary("byte_bpe_50k.json"))
    assert not enc.cuts and tokenfile.Encoder(tokenfile.vocabulary()).cuts
    for t in ODD_TEXTS:
        assert enc.encode(*utf8(pa.array([t])))[0].tolist() == [*enc.tok.encode(t, add_special_tokens=False).ids, 1]


def test_token_files_odd_rows(spark, tmp_path):
    out = str(tmp_path / "t")
    tokenfile.write_tokens(docs_of(spark, [(None, "n"), (3, "c"), (1, "a"), (1, "a"), (2, None)]), out, tokenfile.vocabulary())
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in tokenfile.read_index(spark, out).collect())
    assert [d for _, d, _ in got] == [None, 1, 1, 2, 3] and got[-1][0] == sum(n for *_, n in got[:-1])
    tokenfile.write_tokens(empty(spark), str(tmp_path / "e"), tokenfile.vocabulary())
    assert tokenfile.read_index(spark, str(tmp_path / "e")).count() == 0


# 6. Quality.


def brute_marginals(emit, trans, begin):
    import itertools

    total, good = 0.0, np.zeros(len(emit))
    for y in itertools.product((0, 1), repeat=len(emit)):
        w = begin[y[0]] + sum(e for e, s in zip(emit, y) if s) + sum(trans[a][b] for a, b in zip(y, y[1:]))
        total += np.exp(w)
        good += np.exp(w) * np.array(y)
    return good / total, np.log(total)


def test_forward_backward():
    r = np.random.default_rng(3)
    n = np.array([1, 4, 6, 2])
    emit, trans, begin = r.normal(size=13), r.normal(size=(2, 2)), r.normal(size=2)
    good, norm, both, firsts = quality.forward_backward(emit, trans, begin, n, pairs=True)
    at, logs = 0, 0
    for k in n:
        g, z = brute_marginals(emit[at : at + k], trans, begin)
        assert good[at : at + k] == pytest.approx(g)
        logs, at = logs + z, at + k
    assert both.sum() == pytest.approx((n - 1).sum()) and firsts.sum() == pytest.approx(len(n))
    eps = 1e-5  # the expected pairs are the normaliser's gradient

    def z_of(t):
        return sum(brute_marginals(emit[a : a + k], t, begin)[1] for a, k in zip(np.cumsum(n) - n, n))

    for i in (0, 1):
        for j in (0, 1):
            t = trans.copy()
            t[i, j] += eps
            assert (z_of(t) - z_of(trans)) / eps == pytest.approx(both[i, j], abs=1e-3)


def test_score_is_brute_force():
    """The whole score of short texts: every labelling of the lines by hand, then length weights, then the curve."""
    r = np.random.default_rng(8)
    texts = ["one line", "", None, "Two lines.\nand THIS!!", "a\n\nb longer line here\nb longer line here\n*** $$$", "\n" * 6, "é " * 300 + "\nq"]
    d = 3 * quality.WIDTH
    field = quality.Field(r.normal(size=d), 1 + r.random(d), r.normal(size=d) / 4, 0.3, r.normal(size=(2, 2)), r.normal(size=2), (1.7, -0.4))
    want = []
    for t in texts:
        x, chars, _ = quality.line_features(*utf8(pa.array([t], pa.string())))
        emit = [sum((a - m) / s * w for a, m, s, w in zip(row, field.mean, field.dev, field.w)) + field.bias for row in x]
        good, _ = brute_marginals(np.clip(emit, -30, 30), field.trans, field.begin)
        weight = [len(line) + 1 for line in (t or "").split("\n")]
        assert [c + 1 for c in chars] == weight
        p = min(max(sum(g * w for g, w in zip(good, weight)) / sum(weight), 1e-6), 1 - 1e-6)
        want.append(1 / (1 + np.exp(-(1.7 * np.log(p / (1 - p)) - 0.4))))
    assert field.scores(*quality.line_features(*utf8(pa.array(texts, pa.string())))) == pytest.approx(want, rel=1e-5)


def test_constraint_on_line_labels():
    r = np.random.default_rng(4)
    n = np.array([1, 5, 3, 8, 2])
    emit, chars, label = r.normal(size=19) * 2, r.integers(0, 80, 19).astype(float), np.array([1, 0, 1, 0, 0])
    trans, begin = np.array([[0.5, -0.2], [0.1, 0.4]]), np.zeros(2)
    before = quality.pooled(quality.forward_backward(emit, trans, begin, n)[0], chars, n)
    after = quality.pooled(quality.constrained(emit, trans, begin, chars, n, label)[0], chars, n)
    for was, now, y in zip(before, after, label):
        own = was if y else 1 - was
        assert (now if y else 1 - now) >= 0.6 - 1e-3 and (own < 0.6 or now == pytest.approx(was))


def test_lines_get_labels(spark):
    """Labels are the lines': bad lines that are planted among good ones are found, and many documents have both."""
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    field = quality.fit(docs, labels, quality.held_out_third())
    own = {r.doc_id: r.quality for r in labels.collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    longs = {q: [[x for x in text[d].split("\n") if len(x) > 60][:4] for d in sorted(own) if own[d] == q and zlib.crc32(str(d).encode()) % 3 == 1] for q in (0, 1)}
    mixed = [(k, "\n".join([*a, *b]), len(a)) for k, (a, b) in enumerate(zip(*([x for x in longs[q] if x] for q in (1, 0))))]
    got = {r.doc_id: r.good for r in quality.line_labels(docs_of(spark, [(k, t) for k, t, _ in mixed]), field).collect()}
    assert len(mixed) >= 8
    assert np.mean([p > 0.5 for k, _, n in mixed for p in got[k][:n]]) > 0.65 and np.mean([p < 0.5 for k, _, n in mixed for p in got[k][n:]]) > 0.65
    assert np.mean([max(got[k]) > 0.5 > min(got[k]) for k, *_ in mixed]) > 0.5


def test_quality_sample_is_bounded(spark, monkeypatch):
    seen = []
    train = quality.train
    monkeypatch.setattr(quality, "train", lambda x, *a: seen.append(len(x)) or train(x, *a))
    docs = docs_of(spark, [(i, "a line.\n" * (5000 if i == 3 else 9)) for i in range(20)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    quality.fit(docs, labels, F.lit(False), 6000, 100)
    assert seen == [100]


def test_line_features():
    buf, off = utf8(pa.array(["ab cd.\n\nAB!!", "", "x"]))
    x, chars, n = quality.line_features(buf, off)
    assert n.tolist() == [3, 1, 1] and chars.tolist() == [6, 0, 4, 0, 1] and x.shape == (5, 3 * quality.WIDTH)
    one, _, _ = quality.line_features(*utf8(pa.array(["x"])))
    assert (one == x[4:]).all()


def test_quality_held_out(spark):
    base = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op6(spark, base).collect()}
    rows = spark.read.parquet(f"{base}/labels.parquet").collect()
    assert len(got) == 1000
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.quality, got[r.doc_id].score) for r in rows if got[r.doc_id].held_out]
    good, bad = ([s for q, s in held if q == k] for k in (1, 0))
    assert sum((q == 1) == (s >= 0.5) for q, s in held) / len(held) > 0.95
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.98


def test_quality_odd_rows(spark, real):
    d = docs_of(spark, [(None, None), (1, ""), (2, "\n\n"), (3, "a b.\n" * 3000), (3, "a b.\n" * 3000)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality_scores(d, none).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    odd = spark.createDataFrame([(1, 0), (2, 1), (3, None), (3, 1), (3, 1), (None, 1), (4, 7)], "doc_id long, quality int")
    got = quality.quality_scores(d, odd).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id == 3}) == 1 and not any(np.isnan(r.score) for r in got)
    assert quality.quality_scores(empty(spark), odd).count() == 0
    kept = quality.keep_good(d, none)
    assert kept.columns == d.columns and kept.count() == 5
    assert quality.keep_good(empty(spark), odd).count() == 0
    lines_of = {r.doc_id: len(r.good) for r in quality.line_labels(d, quality.fit(d, odd, F.lit(False))).collect()}
    assert lines_of == {None: 1, 1: 1, 2: 3, 3: 3001}


# 7. LM.


def test_lm_query(spark, sf_dir, real):
    got = {r.doc_id: r for r in lm.op7(spark, sf_dir).collect()}
    assert len(got) == len(real)
    for d, held, n, known, total, base in lm.reference_base(real):
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total) and r.base_score == pytest.approx(base, rel=1e-9)
    better = [r.score > r.base_score for r in got.values() if r.held_out]
    assert sum(better) / len(better) > 0.7


def plain_score(model, text):
    """log10 of a text's probability by plain arithmetic, one token at a time."""
    import math

    def spread(x):
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * times & (1 << 64) - 1
        return x ^ x >> 31

    def log_share(logs, at):
        top = max(logs)
        return logs[at] - top - math.log(sum(math.exp(x - top) for x in logs))

    one_salt, two_salt, pair_salt = (int(lm._SALT[i]) for i in (1, 2, 0))
    h = [int(x) for x in lm.tokens(*utf8(pa.array([text])))[0]]
    sizes, inner = model.sizes, model.inner
    w, total = model.weights.astype(float), 0.0
    for i, x in enumerate(h):
        one = h[i - 1] if i else int(lm._NONE)
        two = h[i - 2] if i > 1 else int(lm._NONE)
        a, b = spread((one + one_salt) % (1 << 64)), spread((two + two_salt) % (1 << 64))
        pair = spread((a * pair_salt + b) % (1 << 64))
        word = int(model.words.find(np.array([x], np.uint64), -1)[0])
        cls = word // lm.PER_CLASS if word >= 0 else lm.CLASSES + (x & 15)
        rows = [a % sizes[0], sizes[0] + b % sizes[1], sizes[0] + sizes[1] + pair % sizes[2]]
        total += log_share([model.start[c] + sum(w[r][c] for r in rows) for c in range(lm.ALL)], cls) / math.log(10)
        count = int(model.counts.find(np.array([x], np.uint64), 0)[0])
        if word >= 0:
            at = sum(sizes) + cls * inner
            rows = [at + (a >> 32) % inner, at + lm.CLASSES * inner + (b >> 32) % inner]
            total += log_share([model.closed[cls][k] + sum(w[r][k] for r in rows) for k in range(lm.PER_CLASS)], word % lm.PER_CLASS) / math.log(10)
        else:
            total += math.log10((count + 1) / model.mass[x & 15])
    return total


def test_lm_score_is_brute_force(spark, monkeypatch):
    """Whole scores on a small corpus, with tokens that travel because few are frequent, against the model's own weights by hand."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    rows = [(d, " ".join(r.choice(words[: r.choice([5, 50, 900])]) for _ in range(r.randrange(60)))) for d in range(150)] + [(200, None), (201, "only here " * 3)]
    docs = docs_of(spark, rows).repartition(3).persist()
    fitted = []
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda x: fitted.append(fit(x)) or fitted[0])
    monkeypatch.setattr(lm, "FREQUENT", 600)
    got = {x.doc_id: x for x in lm.lm_scores(docs).collect()}
    model = fitted[0]
    assert np.abs(model.weights).max() > 0
    counts = {}
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            for x in lm.tokens(*utf8(pa.array([t], pa.string())))[0]:
                counts[int(x)] = counts.get(int(x), 0) + 1
    model.counts = Lookup(np.array([*counts], np.uint64), np.array([*counts.values()]))
    for d, t in rows:
        assert got[d].score == pytest.approx(plain_score(model, t or ""), rel=1e-4)
    docs.unpersist()


def test_lm_tables_grow(spark, real, monkeypatch):
    assert [lm.table_scale(n) for n in (0, 1 << 24, 1 << 26, 1 << 30, 1 << 40)] == [1, 1, 2, 8, 16]
    monkeypatch.setattr(lm, "SCALE_TOKENS", 1 << 10)
    docs = docs_of(spark, real[:80], clash=False).select("text", F.lit(False).alias("held"))
    model = lm.fit(docs)
    assert model.scale > 1 and len(model.weights) == model.scale * (sum(lm.SIZES) + 2 * lm.CLASSES * lm.INNER)
    text = real[3][1][:400]
    h, first = lm.tokens(*utf8(pa.array([text])))
    far = model.words.find(h, -1) < 0
    logs = model.log10(h, first) + np.where(far, np.log10(model.counts.find(h, 0) + 1.0), 0)
    assert logs.sum() == pytest.approx(plain_score(model, text), rel=1e-4)


def test_lm_is_a_distribution(spark, real):
    model = lm.fit(docs_of(spark, real[:60], clash=False).select("text", F.lit(False).alias("held")))
    assert np.abs(model.weights).max() > 0
    h, first = lm.tokens(*utf8(pa.array([real[0][1][:300]])))
    # Every word that is in the vocabulary, and each open class, after the same context.
    keys = model.words.keys[model.words.keys != 0]
    total = 0.0
    tail = np.array([h[3], h[4]])
    for x in [*keys, *(np.uint64((1 << 60) + k) for k in range(lm.OPEN))]:
        seq = np.append(tail, np.uint64(x))
        p = 10 ** model.log10(seq, np.array([0, 3]))[2]
        total += p if model.words.find(seq[2:], -1)[0] >= 0 else p * model.mass[int(x) & 15]
    assert total == pytest.approx(1, abs=1e-4)


def test_lm_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, "a b a"), (2, "a b a"), (3, "Word " * 20000), (4, "never seen words")]
    got = sorted(lm.lm_scores(docs_of(spark, rows)).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    named = [(d, t) for d, t in rows if d is not None]
    assert len(got) == 6 and sum(r.n_tokens for r in got) == sum(len((t or "").split()) + 1 for _, t in rows)
    assert all(np.isfinite([r.score, r.base_score]).all() for r in got)
    only = {r.doc_id: r for r in lm.lm_scores(docs_of(spark, named)).collect()}
    for d, _, n, known, total, base in lm.reference_base(named):
        assert (only[d].n_tokens, only[d].n_known, only[d].train_tokens) == (n, known, total) and only[d].base_score == pytest.approx(base)
    assert lm.lm_scores(empty(spark)).count() == 0


# 8. Substring dedup.


def brute_substrings(rows, width):
    least = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - width + 1):
                k = tuple(w[i : i + width])
                least[k] = min(least.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - width + 1):
                if least[tuple(w[i : i + width])] < d:
                    gone |= set(range(i, i + width))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("width,rounds", [(50, 5), (8, 2), (3, 1), (20, 8)])
def test_substrings(spark, seed, width, rounds, monkeypatch):
    r = random.Random(seed)
    letters = ["a", "b", "é"] if seed % 2 else [f"w{i}" for i in range(60)]
    shared = [[r.choice(letters) for _ in range(r.randrange(width, 3 * width))] for _ in range(3)] + [["run"] * (3 * width)]
    rows = [(None, " ".join(shared[0])), (900, None), (901, ""), (902, " ".join(["run"] * 4000))]
    for d in r.sample(range(800), 30):
        w = []
        for _ in range(r.randrange(1, 5)):
            w += [r.choice(letters) for _ in range(r.randrange(0, 2 * width))]
            w += r.choice(shared)
        rows.append((d, " ".join(w)))
    rows += rows[6:9]
    monkeypatch.setattr(substring, "CHUNK", 2000)
    if seed > 1:  # nearly all names are hot
        monkeypatch.setattr(substring, "HOT", 1 << 40)
    got = substring.substring_dedup(docs_of(spark, rows).repartition(3), width, rounds)
    assert out_of(got) == brute_substrings(rows, width)


def test_substrings_empty(spark):
    assert substring.substring_dedup(empty(spark)).count() == 0
    assert out_of(substring.substring_dedup(docs_of(spark, [(1, "a b")]))) == [(1, 2, 0, "a b")]


def test_windows_under_one_anchor(monkeypatch):
    """Different windows round a shared phrase are no repeats, though half of the bits of their hashes agree."""
    whole = substring.span_hashes
    monkeypatch.setattr(substring, "span_hashes", lambda *x: whole(*x) & np.uint64(0xFFFFFFFF))
    r = random.Random(3)
    phrase = [f"p{i}" for i in range(40)]
    texts = [" ".join([f"{d}a{r.random()}" for _ in range(40)] + phrase + [f"{d}b{r.random()}" for _ in range(40)]) for d in range(20)] * 2
    sent = []
    for d, t in enumerate(texts):
        sent += substring._send(50, 5, np.zeros(0, np.uint64))([pa.RecordBatch.from_arrays([pa.array([d]), pa.array([t])], names=["doc_id", "text"])])
    rows = pa.Table.from_batches(sent).sort_by([("sym", "ascending"), ("doc", "ascending")])
    for size in (100000, 7):
        found = {}
        for x in substring._repeats(rows.combine_chunks().to_batches(max_chunksize=size)):
            for d, at in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                found.setdefault(d, set()).update(np.frombuffer(at, "<i4").tolist())
        assert found == {d: set(range(71)) for d in range(20, 40)}


def test_hot_names(spark):
    """A phrase in every text is hot, its windows are dealt by their words, and none repeats but in the copies."""
    r = random.Random(11)
    phrase = [f"p{i}" for i in range(30)]
    rows = [(d, " ".join([f"{d}a{i}" for i in range(30)] + phrase + [f"{d}b{i}" for i in range(30)])) for d in range(300)]
    rows += [(1000 + d, rows[d][1]) for d in r.sample(range(300), 20)]
    hot = substring.hot_names(docs_of(spark, rows).select("text"))
    assert 0 < len(hot) < substring.HOT
    assert out_of(substring.substring_dedup(docs_of(spark, rows))) == brute_substrings(rows, 50)


def test_one_anchor_is_linear():
    """Twice the rows of one name take about twice the time."""
    import time

    def seconds(n):
        r = np.random.default_rng(n)
        doc = np.arange(n)
        wins = r.integers(0, 2**63, n * 8).astype("<u8")
        rows = substring._row(np.full(n, 7, np.uint64), doc, np.zeros(n, np.int32), np.full(n, 9, np.int32), substring._packed(np.repeat(doc, 8), wins, n), False)
        batches = [rows.slice(i, 2000) for i in range(0, n, 2000)]
        start = time.process_time()
        assert list(substring._repeats(batches)) == []
        return time.process_time() - start

    seconds(10_000)
    assert seconds(160_000) < 3.5 * seconds(80_000)


def test_names_inside_equal_substrings():
    """A name whose words all lie in a shared piece is at the same place in both texts."""
    r = np.random.default_rng(4)
    piece = mix(r.integers(0, 20, 120).astype(np.uint64))
    found = []
    for k in (7, 31):
        text = np.concatenate((mix(r.integers(0, 20, k).astype(np.uint64)), piece, mix(r.integers(0, 20, 40).astype(np.uint64))))
        sym, s, e, frm, to = substring.recompress(text, np.array([0, len(text)]), 5)
        own = (frm >= k) & (to <= k + 120)
        found.append([(int(x), int(a) - k, int(b) - k) for x, a, b in zip(sym[own], s[own], e[own])])
    assert found[0] == found[1] and len(found[0]) > 10


# 9. Mixing.


def test_mixing(spark):
    rows = [(i, "w " * (i % 7), "hot" if i % 3 else "b") for i in range(300)] + [(1000, None, "c"), (1001, "x y", None), (1002, "", "zero"), (None, "n n n", "b"), (None, "n n n", "b"), (5, "dup", "b")]
    got = mixing.mix_sources(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    targets = {s: v[0].target for s, v in by.items()}
    assert sum(targets.values()) == pytest.approx(total)
    for s, v in by.items():
        assert v[0].source_size == sum(r.size for r in v) and sum(r.taken for r in v) == round(targets[s])
    assert out_of(mixing.mix_sources(docs_of(spark, rows).repartition(5))) == sorted(map(tuple, got), key=repr)
    # Sources in code-point order, null last: b, c, hot, zero, null weigh 1, 2, 3, 1, 2.
    assert targets["c"] == 0 and targets["zero"] == 0 and targets[None] == 3 * 2


def brute_targets(sizes, most=3):
    """The target of each source by sharing again and again what is cut off."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] < level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("n", [1, 5, 400])
def test_targets(spark, n):
    r = random.Random(n)
    sizes = {f"host{r.randrange(10**9)}": r.choice([0, 1, 50, 10**5]) for _ in range(n)} | ({None: 7} if n > 1 else {})
    rows = spark.createDataFrame([(s, k) for s, k in sizes.items()] + [(s, 0) for s in sizes], "source string, size long").repartition(4)
    got = {x.source: x.target for x in mixing.source_targets(rows).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(t) for s, t in want.items())


@pytest.mark.parametrize("few", [mixing.FEW_SOURCES, 0])
def test_mixing_stage(spark, few, monkeypatch):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    rows = [(i, "w " * (1 + i % 7), "a" if i % 4 else "b") for i in range(200)] + [(500, "q " * 30, None), (501, None, "a"), (502, "", "c")]
    d = docs_of(spark, rows)
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(d).collect()}
    out = mixing.mix_documents(d)
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert out.columns == d.columns and got == {k: v for k, v in copies.items() if v}
    assert mixing.mix_sources(empty(spark)).count() == 0 and mixing.mix_documents(empty(spark)).count() == 0


# 10. Lines.


def brute_lines(rows, min_docs=5, min_chars=40):
    strip, up = " \t\n\x0b\x0c\r", {ord(a): ord(a) + 32 for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    key = lambda x: x.strip(strip).translate(up)
    own = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= min_chars:
                own.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if d is None or len(own.get(key(x), ())) < min_docs or d == max(own[key(x)])]
        out.append((d, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    long, accent = "This line is long enough to be counted here.", "É" * 20 + "é" * 25 + "A"
    rows = [(i, f"own {i}\n  {long if i % 2 else long.upper()}\t\nshort\n{long}") for i in range(8)]
    rows += [(i, accent + "\n" + "x" * 39) for i in range(20, 26)] + [(i, accent.lower()) for i in range(30, 33)]
    rows += [(None, long), (40, None), (41, ""), (42, "\n"), (3, rows[3][1]), (43, "\r" + long + "\x0b"), (44, ("z" * 50 + "\n") * 3000)]
    rows += [(i, "four documents only have this long long line") for i in range(50, 54)] + [(50, "four documents only have this long long line")]
    assert out_of(lines.line_dedup(docs_of(spark, rows))) == brute_lines(rows)
    rows += [(60, None), (60, f"{long}\nmine"), (60, f"other\n{long}\n\n{long}")]  # three texts of one doc_id
    assert out_of(lines.line_dedup(docs_of(spark, rows))) == brute_lines(rows)
    assert lines.line_dedup(empty(spark)).count() == 0


def test_many_lost_lines_of_one_document(spark):
    """A document that loses half of 40,000 lines takes no longer than its lines warrant."""
    import time

    shared = [f"line number {i:06d} that all of these documents have" for i in range(20_000)]
    rows = [(d, "\n".join(f"{x}\n{d}" for x in shared)) for d in range(5)]
    start = time.time()
    got = lines.line_dedup(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got)[:1] == [(0, 40_000, 20_000, "\n".join(["0"] * 20_000))]
    assert {r.doc_id: r.n_dropped for r in got} == {0: 20_000, 1: 20_000, 2: 20_000, 3: 20_000, 4: 0} and time.time() - start < 30
