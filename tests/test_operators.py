"""Hand-computed cases of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import calculator, media
from tessera.functions import text as T
from tessera.functions import vector as V
from tessera.operators import chat, dedup, enrich, filters, fusion, graph, hierarchy, search, splitters


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return row.select(expr.alias("x")).first().x


@pytest.fixture(scope="module")
def lists(spark):
    return spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.6), (0, 3, 0.3), (1, 2, 5.0), (1, 4, 1.0)], "list_id int, id long, score double").cache()


def scores(df):
    return {r.id: round(r.score, 6) for r in df.collect()}


def test_fusion(lists):
    assert scores(fusion.rrf(lists)) == {2: 0.033060, 1: 0.016667, 4: 0.016393, 3: 0.016129}
    assert scores(fusion.weighted_average(lists, [0.7, 0.3])) == {1: 1.0, 2: 0.65, 3: 0.0, 4: 0.0}
    assert scores(fusion.linear(lists, [0.7, 0.3])) == {1: 0.7, 2: 0.65, 3: 0.0, 4: 0.0}
    assert scores(fusion.distribution_based(lists, [0.5, 0.5])) == {2: 0.615529, 1: 0.386449, 4: 0.134471, 3: 0.113551}
    assert scores(fusion.distance_based(lists, [1, 1]))[2] == 0.625
    assert scores(fusion.keep_max(lists))[2] == 5.0
    assert {r.id: r.votes for r in fusion.votes(lists).collect()} == {1: 1, 2: 2, 3: 1, 4: 1}
    with pytest.raises(ValueError):
        fusion.fuse("weighted", lists, [1.0])
    with pytest.raises(ValueError):
        fusion.fuse("nothing", lists)


def test_bm25(spark):
    assert [round(math.log((5 - n + 0.5) / (n + 0.5)), 6) for n in (1, 2)] == [1.098612, 0.336472]
    docs = spark.createDataFrame([(1, "qq qq"), (2, "aa bb"), (3, "aa bb"), (4, "aa bb"), (5, "aa bb")], "doc_id long, text string")
    hits = search.bm25(docs, ["qq"]).collect()
    assert [(r.doc_id, round(r.score, 6)) for r in hits] == [(1, 1.510592)]
    assert search.bm25(docs, ["aa"]).count() == 0  # in over half of the documents
    batch = search.bm25_batch(docs, spark.createDataFrame([(7, "qq zz")], "qid long, text string")).collect()
    assert [(r.qid, r.id, round(r.score, 6), r["rank"]) for r in batch] == [(7, 1, 1.510592, 1)]


def test_bm25_batch_sends_best_rows(spark, duck, monkeypatch):
    """As the SQL with ties, rows of one id, missing texts and ids, queries in blocks and small tiles; no posting is shuffled."""
    texts = ["aa bb cc", "aa aa dd", "Ee, ff! x", None, "", "cc dd ee ff gg", "hh ii jj", "aa hh"] + ["kk ll mm nn"] * 12
    asks = [(1, "aa kk kk ee"), (2, "hh ii aa"), (None, "dd cc nn"), (4, "zz"), (5, None), (1, "bb")]
    one_each = list(enumerate(texts * 5))
    for own in (one_each, [*one_each, (None, "aa kk")], [(i // 2, "jj bb") if i < 20 else (i, t) for i, t in one_each]):
        docs = spark.createDataFrame(own, "doc_id long, text string").repartition(5)
        queries = spark.createDataFrame(asks, "qid long, text string")
        con = duck.cursor()
        con.execute("CREATE TEMP TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.execute("CREATE TEMP TABLE benchmark (item_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", own)
        con.executemany("INSERT INTO benchmark VALUES (?, ?)", asks)
        want = sorted(con.execute(catalog.ORACLES["bm25_batch"]).fetchall(), key=repr)
        con.close()
        with monkeypatch.context() as m:
            m.setattr(search, "PAIRS", 30)
            for block in (1, 4096):
                hits = search.bm25_batch(docs, queries, block=block)
                got = [(r.qid, r.id, round(r.score, 6), r["rank"]) for r in hits.collect()]
                assert sorted(got, key=repr) == want and len(want) > 20
    names = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert {r.id[0] for r in search.bm25_batch(names, queries).collect()} == {"d"}
    plan = search.bm25_batch(spark.createDataFrame(one_each, "doc_id long, text string"), queries)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Generate" not in plan


def test_terms(spark):
    assert one(spark, T.terms(F.lit("Don't stop, a B2!"))) == ["dont", "stop", "b2"]


def test_keyword_search(spark):
    docs = spark.createDataFrame([(1, "aaa aaa bbb ccc")], "doc_id long, text string")
    assert search.keyword_search(docs, ["aaa", "ccc", "zzz"]).first().score == pytest.approx(0.25)
    assert search.keyword_search(docs, ["aaa", "zzz"], all_of=True).count() == 0
    assert one(spark, search.summary_score(["a", "b", "b", "c"], F.lit("b x"))) == 0.5


def test_vectors(spark):
    a, b, z = ([float(x) for x in v] for v in ((1, 0, 0), (0, 1, 0), (0, 0, 0)))
    lit = search.vector_literal
    assert [one(spark, V.METRICS[m](lit(a), lit(b))) for m in ("cosine", "dot")] == [0, 0]
    assert one(spark, V.euclidean(lit(a), lit(b))) == pytest.approx(1 / (1 + math.sqrt(2)))
    assert one(spark, V.manhattan(lit(a), lit(b))) == pytest.approx(1 / 3)
    assert one(spark, V.cosine(lit(a), lit(z))) == 0 and one(spark, V.euclidean(lit(a), lit(a))) == 1
    assert one(spark, V.normalize(lit([3.0, 4.0]))) == pytest.approx([0.6, 0.8])
    assert one(spark, V.mean_pool(F.array(lit(a), lit(b)))) == pytest.approx([0.5, 0.5, 0])
    with pytest.warns(UserWarning):
        assert V.metric("angle") is V.cosine


def test_knn(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.9, 0.1, 0.0]), (4, [0.9, 0.1, 0.0])], "vec_id long, embedding array<float>")
    hits = search.knn(rows, [1, 0, 0], 2).collect()
    assert [r.vec_id for r in hits] == [1, 3] and hits[0].score == pytest.approx(1)
    assert search.knn(rows, [1, 0, 0], 9, threshold=0.5).count() == 3
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0])], "qid long, embedding array<float>")
    for block in (1, 10):
        got = search.knn_batch(rows, q, 2, block=block).orderBy("qid", "rank").collect()
        assert [(r.qid, r.id) for r in got] == [(0, 1), (0, 3), (5, 2), (5, 3)]
    assert search.knn_batch(rows, q.limit(0)).count() == 0
    with pytest.raises(ValueError):
        search.hybrid(rows, rows, 1.5)


def test_knn_batch_in_tiles():
    """Against plain sorting, copies of a vector among the rows; memory stays far below queries times rows."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    v = r.normal(size=(3000, 16)).astype(np.float32)
    v[::7] = v[5]
    q, ids = v[:600].astype(float), np.arange(len(v))[::-1].copy()
    for metric in ("cosine", "dot", "euclidean"):
        batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 1100]), pa.array(list(v[i : i + 1100]))], names=["id", "v"]) for i in range(0, len(v), 1100)]
        tracemalloc.start()
        got = list(search._best((np.arange(len(q)), q), 10, metric)(batches))
        assert tracemalloc.get_traced_memory()[1] < 60e6
        tracemalloc.stop()
        rows = [r for b in got for r in b.to_pylist()]
        assert len(rows) == 10 * len(q)
        w = v.astype(float)
        for i in range(0, len(q), 37):
            s = search._exact(q, w, np.full(len(w), i), np.arange(len(w)), metric)
            best = np.lexsort((ids, -s))[:10]
            assert [(r["id"], r["score"]) for r in rows if r["qid"] == i] == list(zip(ids[best].tolist(), s[best].tolist(), strict=True))


def test_ivf_recall(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    c, index = search.ivf_index(e)
    index = index.cache()
    assert index.count() == e.count()
    found = total = 0
    for q in e.filter("vec_id % 100 = 0").collect():
        exact = {r.vec_id for r in search.knn(e, q.embedding).collect()}
        found += len(exact & {r.id for r in search.ivf_search(index, c, q.embedding, probe=12).collect()})
        total += len(exact)
    assert found / total >= 0.9


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_ann_ivf_recall(spark, size):
    """The registered query, as it is, against the exact one."""
    found, exact = ({(r.qid, r.id) for r in catalog.QUERIES[n](spark, f"/root/testdata/{size}").collect()} for n in ("ann_ivf", "knn_batch"))
    print("recall", size, len(found & exact) / len(exact))
    assert len(found) == len(exact) and len(found & exact) >= 0.9 * len(exact)


def test_ivf_batch_is_ivf_search(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    c, index = search.ivf_index(e)
    q = e.filter("vec_id = 7").select(F.col("vec_id").alias("qid"), "embedding")
    want = [r.id for r in search.ivf_search(index, c, q.first().embedding, probe=3).collect()]
    assert [r.id for r in search.ivf_search_batch(index, c, q, probe=3).orderBy("rank").collect()] == want


def test_dedup_beyond_limit(spark):
    hits = spark.createDataFrame([(0, i, 1 - i / 10, ["a"] if i < 2 else [f"w{i}"]) for i in range(6)], "qid int, doc_id long, score double, words array<string>")
    assert sorted(r.doc_id for r in dedup.greedy(hits, ["qid"], "doc_id", "words", limit=3).collect()) == [0, 2, 3, 4, 5]


def test_diversity_is_greedy(spark):
    """The next is always the best after the penalty; scores stay, and top_n cuts."""
    rows = [(0, 1, 0.9, "a b"), (0, 2, 0.85, "a b"), (0, 3, 0.6, "c"), (0, 4, 0.55, "c"), (0, 5, 0.1, ""), (1, 1, 0.5, "z")]
    hits = spark.createDataFrame([(q, i, s, t.split()) for q, i, s, t in rows], "qid int, doc_id long, score double, words array<string>")

    def brute(own, top_n):
        left, out = sorted(own, key=lambda x: -x[2]), []
        while left and len(out) < top_n:
            def worth(x):
                like = max((len(set(x[3].split()) & set(y[3].split())) / max(1, len(set(x[3].split()) | set(y[3].split()))) for y in out), default=-1)
                return x[2] - (0.5 * like if like > 0.8 else 0)
            best = max(left, key=worth)
            left.remove(best)
            out.append(best)
        return [(x[0], x[1], x[2], k) for k, x in enumerate(out, 1)]

    for n in (2, 4, 10):
        want = brute(rows[:5], n) + brute(rows[5:], n)
        got = dedup.diversity(hits, ["qid"], "doc_id", "words", top_n=n).select("qid", "doc_id", "score", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_filters(spark):
    hits = spark.createDataFrame([(0, 0.3), (1, 0.7), (2, 0.9)], "rank int, score double")
    assert [r.score for r in filters.similarity_cutoff(hits, 0.5, 1).collect()] == [0.7]
    assert one(spark, filters.keyword_predicate(F.lit("Climate is changing"), ["climate", "change"], ["spam"]))
    assert not one(spark, filters.keyword_predicate(F.lit("Climate spam"), ["climate"], ["spam"]))
    assert not one(spark, filters.keyword_predicate(F.lit("changing"), ["change"]))
    assert one(spark, filters.keyword_predicate(F.lit("a foo-bar (x)"), ["FOO"])) and one(spark, filters.keyword_predicate(F.lit("a foo-bar"), ["foo-bar"]))
    assert one(spark, filters.keyword_predicate(F.lit("on climate change now"), ["climate change"])) and not one(spark, filters.keyword_predicate(F.lit("climate, change"), ["climate change"]))
    assert not one(spark, filters.keyword_predicate(F.lit("caféx"), ["café"])) and one(spark, filters.keyword_predicate(F.lit("un café."), ["CAFÉ"])) and not one(spark, filters.keyword_predicate(F.lit("a.c"), ["a+c"]))
    assert not one(spark, filters.keyword_predicate(F.lit("Climate"), ["climate"], case_sensitive=True))
    docs = spark.createDataFrame([(1, "short"), (2, "long enough"), (3, "long enough")], "doc_id long, text string")
    assert [r.doc_id for r in filters.admit(docs).collect()] == [2]
    assert filters.chain(docs, [lambda d: d.filter("doc_id > 1"), lambda d: d.select("nothing")], True).count() == 2
    with pytest.raises(Exception):
        filters.chain(docs, [lambda d: d.select("nothing")])
    s = spark.createDataFrame([(1, 0.5, "aa bb. cc dd. ee ff. gg hh. ii jj.")], "doc_id long, score double, text string")
    assert filters.sentence_optimizer(s, ["aa"], 0.7, context=0).first().kept == 4


def test_dedup(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "doc_id string, text string")
    known = docs.select("doc_id", T.document_hash(F.when(F.col("doc_id") == "b", "old").otherwise(F.col("text"))).alias("hash")).filter("doc_id <> 'a'")
    assert {r.doc_id: r.status for r in dedup.status(docs, known).collect()} == {"a": "process", "b": "update", "c": "skip"}
    assert {r.doc_id: r.status for r in dedup.status(docs, known, "duplicates_only").collect()}["b"] == "skip"
    assert [r.doc_id for r in dedup.deleted(docs.filter("doc_id = 'b'"), known).collect()] == ["c"]
    hits = spark.createDataFrame([(0, 1, 0.9, ["a", "b"]), (0, 2, 0.8, ["a", "b"]), (0, 3, 0.7, ["c"])], "qid int, doc_id long, score double, words array<string>")
    assert sorted(r.doc_id for r in dedup.greedy(hits, ["qid"], "doc_id", "words").collect()) == [1, 3]
    assert [r.doc_id for r in dedup.diversity(hits, ["qid"], "doc_id", "words").orderBy("rank").collect()] == [1, 3, 2]
    seq = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "a")], "i int, x string").withColumn("g", F.lit(0))
    assert [r.i for r in dedup.adjacent(seq, ["g"], "i", ["x"]).orderBy("i").collect()] == [1, 3, 5]


def test_auto_merge(spark):
    nodes = spark.createDataFrame([("p", None), ("q", None), ("p1", "p"), ("p2", "p"), ("p3", "p"), ("q1", "q"), ("q2", "q"), ("q3", "q"), ("q4", "q")], "node_id string, parent_id string")
    hits = spark.createDataFrame([("p1", 0.8), ("p2", 0.6), ("q1", 0.5), ("q2", 0.4)], "node_id string, score double")
    assert {r.node_id: round(r.score, 6) for r in hierarchy.auto_merge(hits, nodes).collect()} == {"p": 0.7, "q1": 0.5, "q2": 0.4}
    assert hierarchy.leaves(nodes).count() == 7 and hierarchy.roots(nodes).count() == 2
    assert hierarchy.deeper_than(nodes, 0).count() == 7


def test_splitters():
    text = "First one here. Second one there! Third one? Fourth."
    chunks = splitters.split_sentences(text, 4, 0)
    assert " ".join(chunks).split() == text.split() and all(len(c.split()) <= 6 for c in chunks)
    assert splitters.split_sentences("", 4, 0) == splitters.split_sentences(None, 4, 0) == []
    assert splitters.split_sentences("x" * 10, 1, 0) == ["x" * 10]
    with pytest.raises(ValueError):
        splitters.split_sentences("a", 0)
    assert splitters.offsets("ab cd ab", ["ab", "cd", "ab"]) == [(0, 2), (3, 5), (6, 8)]
    md = splitters.split_markdown("intro\n# A\none\n## B\ntwo\n```\n# no\n```\n# C\nthree")
    assert [(s["path"], s["level"]) for s in md] == [("/", 0), ("/A/", 1), ("/A/B/", 2), ("/C/", 1)]
    assert splitters.split_html("<p>A long paragraph</p><script>var x</script><li>tiny</li>") == [{"tag": "p", "content": "A long paragraph"}]
    assert splitters.split_json('{"a": {"name": "something"}, "list": [1, 2]}') == ["list: [Array with 2 items]", "Path: a\nname: something"]
    assert splitters.split_json("not json") == []
    code = "import os\n\ndef a():\n    pass\n\nclass B:\n    pass\n"
    assert "".join(splitters.split_code(code)).replace("\n", "") == code.replace("\n", "")
    assert splitters.code_facts(code)["functions"] == ["a"] and splitters.code_facts(code)["classes"] == ["B"]


def test_native_windows(spark):
    assert one(spark, splitters.char_windows(F.lit("abcdef"), 4, 1)) == ["abcd", "def"]
    assert one(spark, splitters.char_windows(F.lit(""), 4, 1)) == []
    rows = spark.createDataFrame([(1, "a b c d"), (2, ""), (3, None), (1, "a b c d")], "doc_id long, text string")
    got = splitters.token_windows(rows, 2, 1).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.content) for r in got] == [(1, "a b"), (1, "b c"), (1, "c d"), (1, "d")]
    docs = spark.createDataFrame([(1, "First sentence. Second sentence. Third sentence.")], "doc_id long, text string")
    rows = splitters.sentence_windows(docs, 1).orderBy("chunk_index").collect()
    assert len(rows) == 3 and rows[1].window == "First sentence. Second sentence. Third sentence."


def test_semantic_chunks(spark):
    rows = [(1, i, f"s{i}", [1.0, 0.0] if i < 15 else [0.0, 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_index int, original_text string, embedding array<double>")
    got = splitters.semantic_chunks(df).collect()
    assert sorted(len(r.content.split()) for r in got) == [15, 15]
    assert splitters.semantic_chunks(df.filter("chunk_index >= 10 and chunk_index < 20")).count() == 1  # too few to split


def test_graph(spark):
    v = spark.createDataFrame([(n.lower(), n, "x") for n in ("Alice", "Bob", "Microsoft", "Seattle")], "id string, name string, label string")
    e = spark.createDataFrame([("alice", "WORKS_AT", "microsoft"), ("bob", "WORKS_AT", "microsoft"), ("microsoft", "LOCATED_IN", "seattle"), ("ghost", "X", "bob")], "source string, label string, target string")
    e = graph.valid_edges(v, e)
    assert e.count() == 3
    t = graph.triplets(v, e)
    assert graph.matching(t, entities=["Alice"]).count() == 1 and graph.matching(t).count() == 0
    assert {r.id: r.hops for r in graph.k_hop(e, v.filter("id = 'alice'")).collect()} == {"alice": 0, "microsoft": 1, "bob": 2, "seattle": 2}
    best = graph.scored_triplets(t, "where works Alice", {"WORKS_AT": ["works"]}).orderBy(F.desc("score")).first()
    assert best.text == "Alice works at Microsoft"


def test_chat(spark):
    m = spark.createDataFrame([(1, i, "system" if i == 0 else "user", "x" * 10) for i in range(10)], "conv_id long, turn long, role string, text string")
    assert one(spark, chat.tokens(F.lit("x" * 10))) == 5
    assert sorted(r.turn for r in chat.truncated(m, 25, 50).collect()) == [0, 6, 7, 8, 9]
    assert sorted(r.turn for r in chat.truncated(m, 4000, 3).collect()) == [0, 8, 9]
    assert [r.turn for r in chat.recent(m, 2).orderBy("turn").collect()] == [8, 9]
    assert chat.without_nth(m, 0).count() == 9


def test_enrich(spark):
    x = one(spark, enrich.entities(F.lit("John Smith works at Acme Corp in Paris, mail a@b.co, call 555-123-4567")))
    assert [(r.label, r.text) for r in x if r.label != "ORG"] == [("PERSON", "John Smith"), ("PERSON", "Acme Corp"), ("LOCATION", "Acme Corp"), ("LOCATION", "Paris"), ("EMAIL", "a@b.co"), ("PHONE", "555-123-4567")]
    assert all((r.start, r.end) == (14 + 6, 29) for r in x if r.text == "Acme Corp") or x[0].start == 0
    many = " and ".join(f"Jo{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abc'[i // 26]} Smith" for i in range(60)) + " http://x.org/y on 2024-01-02 for $5"
    x = one(spark, enrich.entities(F.lit(many)))
    assert len(x) == 63 and [r.label for r in x[-3:]] == ["URL", "DATE", "MONEY"] and [r.start for r in x] == sorted(r.start for r in x)
    assert len(one(spark, enrich.entities(F.lit(many), 50))) == 50 and one(spark, enrich.entities(F.lit(None).cast("string"))) == []
    found = F.expr("array(named_struct('label', 'PERSON', 'text', 'Ann Lee', 'confidence', 0.9D), named_struct('label', 'LOCATION', 'text', 'Rome', 'confidence', 0.8D))")
    assert one(spark, enrich.grouped_entities(found, 0.85)) == {"PERSON": ["Ann Lee"]}
    related = F.expr("array(named_struct('label', 'L', 'source', 'ann lee', 'target', 'ROME'), named_struct('label', 'L', 'source', 'x', 'target', 'Rome'))")
    assert [r.source for r in one(spark, enrich.known_relations(related, found))] == ["ann lee"]
    assert one(spark, enrich.parse_keywords(F.lit("B, a, b,, c"), 2)) == ["a", "b"]
    t = one(spark, enrich.parse_triplets(F.lit("(A, likes, B)\n(a, Likes, b)\n(X, is, Y)\n(C, owns, C)")))
    assert [(r.s, r.p, r.o) for r in t] == [("a", "likes", "b")]
    r = one(spark, enrich.relations(F.lit("John Smith works at Acme. Acme is located in Paris.")))
    assert [(x.label, x.source, x.target) for x in r] == [("WORKS_AT", "John Smith", "Acme"), ("LOCATED_IN", "Acme", "Paris")]
    assert one(spark, T.entity_mentions(F.lit("What does Alice Smith know"))) == ["Alice", "Alice Smith", "Smith", "What"]
    docs = spark.createDataFrame([(1, "one two two"), (2, None)], "doc_id long, text string").fillna("")
    v = {r.doc_id: r.embedding for r in enrich.embed(docs).collect()}
    assert sum(x * x for x in v[1]) == pytest.approx(1) and sum(v[2]) == 0


def test_text(spark):
    assert one(spark, T.clean_text(F.lit(" a \x01 b\n c "))) == "a b c"
    assert one(spark, T.normalize_text(F.lit("a \t b\r\n\n\n\nc"))) == "a b\n\nc"
    assert one(spark, T.truncate_text(F.lit("hello big world"), 8)) == "hello..."
    assert one(spark, T.jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))) == 0.5
    assert one(spark, T.title(F.lit("# Head\nx"))) == "Head"
    assert one(spark, T.sanitize_filename(F.lit("a b/c.txt"))) == "a_b_c.txt"
    assert one(spark, T.format_duration(F.lit(3725))) == "1:02:05"
    assert one(spark, T.main_points(F.lit("Short. This is a point that is long enough. No."))) == ["This is a point that is long enough"]


def test_calculator():
    assert calculator.evaluate("2 + 3 * 4") == 20 and calculator.evaluate("sqrt(16) ^ 2") == 16
    assert calculator.evaluate("-(2+1)*pi") == pytest.approx(-3 * math.pi)
    for bad in ("", "2 +", "(1", "2 $ 3"):
        with pytest.raises(ValueError):
            calculator.evaluate(bad)


def test_media(spark):
    assert one(spark, media.format_of(F.unhex(F.lit("89504E470D0A1A0A")))) == "png"
    assert one(spark, media.mime_of(F.lit("/a/b.MD"))) == "text/markdown"
    h = one(spark, media.hsv(F.lit(255), F.lit(0), F.lit(0)))
    assert (h.h, h.s, h.v) == (0, 1, 1)
    floats = F.array(*[F.lit(float(x)) for x in (0, 2, 4, 6)])
    assert one(spark, media.resample(floats, 2, 4)) == [0, 1, 2, 3, 4, 5, 6, 6]
    assert one(spark, media.mono(floats)) == [1, 5] and one(spark, media.peak_normalize(floats))[-1] == 1
    assert one(spark, media.encoding_of(F.unhex(F.lit("EFBBBF41")))) == "utf-8-bom"
    assert one(spark, media.encoding_of(F.unhex(F.lit("E9")))) == "latin-1"
    b = one(spark, media.box(F.lit(10), F.lit(20), F.lit(30), F.lit(40), F.lit(100), F.lit(200), True))
    assert (b.x, b.y, b.w, b.h) == (0.1, 0.1, 0.3, 0.2)


def test_content_type_and_language(spark):
    for text, kind in (("x `y` z", "code"), ("a\n  def f", "code"), ("define", "text"), ("# Title", "markdown"), ("a*b", "markdown"), ('json {"a": 1}', "json"), ("1 < 2 > 0", "html"), ("The Conclusion", "academic"), ("rapid", "documentation"), ("plain", "text")):
        assert one(spark, T.content_type(F.lit(text))) == kind
    assert one(spark, T.language_guess(F.lit("theforthinbutter of"))) == "en" and one(spark, T.language_guess(F.lit("xyz"))) is None and one(spark, T.language_guess(F.lit("中文文本"))) == "zh"
    q = [tuple(one(spark, T.query_class(F.lit(t)))) for t in ("an Overview", "code it", "How so", "else", "how " * 20, "detail " * 20)]
    assert q == [("summary", 2), ("code_specific", 2), ("detailed", 2), ("summary", 2), ("detailed", 3), ("detailed", 4)]


def test_unknown_metric_is_cosine(spark):
    from tessera.functions import vector as V

    with pytest.warns(UserWarning):
        assert V.metric("custom") is V.cosine


def test_split_tokens():
    text = "a b c d e f g h\ni j"
    got = splitters.split_tokens(text, 3, 1)
    assert got == ["a b c ", "c d e ", "e f g ", "g h\ni j"] or all(len(x.split()) <= 3 for x in got)
    assert all(x in text and len(x.split()) <= 3 for x in got) and got[0] == "a b c " and got[1].startswith("c ")
    assert splitters.split_tokens("x" * 50, 3, 0) == ["x" * 50] and splitters.split_tokens(None) == splitters.split_tokens("  ") == []
    assert "".join(splitters.split_tokens("one two three four", 1, 0)) == "one two three four"
    with pytest.raises(ValueError):
        splitters.split_tokens("a", 0)


def test_split_points():
    text = "aaaa bbbb. cccc dddd\n\neeee ffff gggg"
    for size in (4, 8, 12, 20):
        at, out = 0, splitters.split_points(text, size)
        for p in out:
            assert at + size <= p <= at + size + size // 4 + 1
            at = p
        assert len(text) - at <= size
    assert splitters.split_points("x" * 9, 8) == [8] and splitters.split_points(None, 5) == [] and splitters.split_points("aaaaaaaa. b c d e f", 8)[0] == 9


def test_metadata_leaves_room(spark):
    assert [splitters.effective_size(8, n) for n in (0, 5, 8, 20)] == [8, 3, 2, 2]
    docs = spark.createDataFrame([(1, "a b c d e f", "k v"), (2, "a b c d e f", None)], "doc_id long, text string, metadata string")
    got = splitters.split_with_metadata(docs, 4, 0, split=splitters.split_tokens).collect()
    assert [max(len(r.chunk.split()) for r in got if r.doc_id == d) for d in (1, 2)] == [2, 4]


def test_build_nodes(spark):
    import uuid

    docs = spark.createDataFrame([(7, "ab cd ab cd ef"), (8, None)], "doc_id long, text string")
    rows = splitters.build_nodes(docs, lambda t: splitters.split_tokens(t, 2, 0)).orderBy("chunk_index").collect()
    assert [r.node_id for r in rows] == [str(uuid.uuid5(uuid.NAMESPACE_OID, f"7-{i}")) for i in range(3)]
    assert [(r.start, r.end, r.words) for r in rows] == [(0, 5, 2), (6, 11, 2), (12, 14, 1)]
    assert [r.prev_id for r in rows] == [None, rows[0].node_id, rows[1].node_id] and rows[1].next_id == rows[2].node_id


def test_windows_are_linear(spark):
    import time

    def seconds(n):
        docs = spark.createDataFrame([(1, "w " * n)], "doc_id long, text string")
        start = time.time()
        assert splitters.token_windows(docs, 100, 20).count() == -(-n // 80)
        return time.time() - start

    seconds(1000)
    assert seconds(80_000) < 3 * max(1, seconds(40_000))


def test_window_queries_shuffle_no_texts(spark, tmp_path):
    """Windows are made in their row and only hashes are linked; repeated rows as in the SQL, each with its windows."""
    docs = spark.createDataFrame([(1, "a b " * 100), (2, " \n\t"), (3, None), (4, "x\n" * 60), (1, "a b " * 100)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, n in (("token_window", 3 + 3 + 1), ("code_line_window", 1 + 1 + 1 + 3)):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and plan.index("md5") > plan.index("Window")
        assert got.count() == n


def test_split_with_sends_parts(spark, sf_dir, monkeypatch):
    """Chunks go in parts of bounded size, all of them and in order."""
    monkeypatch.setattr(splitters, "SENT", 5000)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = [tuple(r) for r in catalog.QUERIES["html_sections"](spark, sf_dir).collect()]
    want = [(r.page_id, i, c["tag"], c["content"]) for r in pages.collect() for i, c in enumerate(splitters.split_html(r.html))]
    assert sorted(got) == sorted(want) and len(want) > 100
    plan = splitters.split_with(pages, splitters.split_html, "page_id", "html", "array<struct<tag: string, content: string>>")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_rerank_orders(spark):
    hits = spark.createDataFrame([(i, float(i)) for i in range(30)], "id long, score double")
    assert [r.id for r in search.reranked(hits, "asc", 3).collect()] == [0, 1, 2] and [r.id for r in search.reranked(hits).collect()] == [*range(29, 19, -1)]
    a, b = ([r.id for r in search.reranked(hits, "random", 30, seed=s).collect()] for s in (1, 2))
    assert a != b and sorted(a) == sorted(b) == [*range(30)] and a == [r.id for r in search.reranked(hits, "random", 30, seed=1).collect()]
