"""The reference-style queries: each a Spark plan over the test tables and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import media as M
from tessera.functions import text as T
from tessera.functions import vector as V
from tessera.operators import chat, dedup, enrich, filters, fusion, graph, hierarchy, search, splitters
from tessera.streaming import ingest

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _q(spark, d, vec_id: int = 0) -> list[float]:
    """The query vector: one row."""
    return list(_t(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


def _r(name: str = "score"):
    return F.round(name, 6).alias(name)


QV = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
E_ = "embedding::DOUBLE[]"
SIM = {"cosine": f"list_cosine_similarity({E_}, q.v)", "dot": f"list_inner_product({E_}, q.v)", "euclidean": f"1 / (1 + list_distance({E_}, q.v))", "manhattan": "1 / (1 + list_sum(list_transform(range(1, 65), lambda i: abs(embedding[i]::DOUBLE - q.v[i]))))"}
TOK = r"list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N} \t\n\r\f\x0B]', '', 'g'), '[ \t\n\r\f\x0B]+'), lambda w: strlen(w) >= 2)"
STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
KEY = rf"list_filter(string_split_regex(lower(text), '[ \t\n\r\f\x0B!-/:-@\[-`{{-~]+'), lambda w: strlen(w) BETWEEN 2 AND 50 AND w NOT IN {STOP})"
WS = r"list_filter(string_split_regex({}, '[ \t\n\r\f\x0B]+'), lambda w: w <> '')"
SENT = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\x0B]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '')"
TERMS = ["thand", "ersh", "heth", "reat", "tiea", "inst"]
LIT = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
WORDS = ["tion", "thth"]

# Vector search.


def _knn_sql(metric: str, where: str = "true", extra: str = "") -> str:
    return f"SELECT vec_id, label, round({SIM[metric]}, 6) AS score FROM embeddings, (SELECT {QV} AS v) q WHERE {where} {extra} ORDER BY {SIM[metric]} DESC, vec_id LIMIT 10"


def _knn(spark, d, metric, where=None, threshold=None):
    e = _t(spark, d, "embeddings")
    hits = search.knn(e, _q(spark, d), 10, metric=metric, where=where, threshold=threshold)
    return hits.join(e.select("vec_id", "label"), "vec_id").select("vec_id", "label", _r())


for _m in SIM:
    query(f"knn_{_m}", _knn_sql(_m))(lambda s, d, m=_m: _knn(s, d, m))
query("knn_filtered", _knn_sql("cosine", "label = 3"))(lambda s, d: _knn(s, d, "cosine", F.col("label") == 3))
query("flagship_filtered_knn", _knn_sql("cosine", f"label <> 3 AND {SIM['cosine']} >= 0.05"))(lambda s, d: _knn(s, d, "cosine", F.col("label") != 3, 0.05))


@query("knn_threshold", f"SELECT vec_id, round({SIM['cosine']}, 6) AS score FROM embeddings, (SELECT {QV} AS v) q WHERE {SIM['cosine']} >= 0.1")
def knn_threshold(spark, d):
    return search.scored(_t(spark, d, "embeddings"), _q(spark, d)).filter("score >= 0.1").select("vec_id", _r())


@query("knn_batch", f"""SELECT qid, vec_id AS id, round(score, 6) AS score, rank FROM (
 SELECT q.qid, vec_id, {SIM['cosine']} AS score, row_number() OVER (PARTITION BY q.qid ORDER BY {SIM['cosine']} DESC, vec_id) AS rank
 FROM embeddings, (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0) q) WHERE rank <= 10""")
def knn_batch(spark, d):
    e = _t(spark, d, "embeddings")
    return search.knn_batch(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")).select("qid", "id", _r(), "rank")


@query("vector_norms", f"SELECT vec_id, round(sqrt(list_inner_product({E_}, {E_})), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("ann_ivf")
def ann_ivf(spark, d):
    e = _t(spark, d, "embeddings")
    c, index = search.ivf_index(e)
    return search.ivf_search_batch(index, c, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")).select("qid", "id", _r(), "rank")


# Keyword search.


@query("bm25_search", f"""WITH d AS (SELECT doc_id, {TOK} AS w FROM documents),
 s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
 p AS (SELECT doc_id, len(w) AS dl, t, len(list_filter(w, lambda x: x = t)) AS tf FROM d, (SELECT unnest({LIT}) AS t) q),
 f AS (SELECT t, count(*) FILTER (WHERE tf > 0) AS df FROM p GROUP BY t)
 SELECT doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
 FROM p JOIN f USING (t), s GROUP BY doc_id HAVING sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0) * tf) > 0 ORDER BY score DESC, doc_id LIMIT 100""")
def bm25_search(spark, d):
    hits = search.bm25(_t(spark, d, "documents"), TERMS, None).select("doc_id", _r())
    return hits.orderBy(F.desc("score"), "doc_id").limit(100)


@query("bm25_batch", f"""WITH d AS (SELECT doc_id, {TOK} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
 p AS (SELECT t, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM d) GROUP BY t, doc_id),
 f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
 q AS (SELECT item_id AS qid, t, count(*) AS qtf FROM (SELECT item_id, unnest({TOK}) AS t FROM benchmark) GROUP BY 1, 2),
 h AS (SELECT qid, doc_id AS id, sum(qtf * greatest(ln((n - df + 0.5) / (df + 0.5)), 0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
       FROM p JOIN f USING (t) JOIN q USING (t), s GROUP BY 1, 2)
 SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM h WHERE score > 0) WHERE rank <= 10""")
def bm25_batch(spark, d):
    q = _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return search.bm25_batch(_t(spark, d, "documents"), q).select("qid", "id", _r(), "rank")


@query("bm25_idf", f"""WITH d AS (SELECT doc_id, {TOK} AS w FROM documents), n AS (SELECT count(*) AS n FROM d)
 SELECT t AS term, df, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 0), 6) AS idf FROM (
 SELECT t, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS t FROM d) GROUP BY t), n""")
def bm25_idf(spark, d):
    p = search.postings(_t(spark, d, "documents"))
    n = _t(spark, d, "documents").agg(F.count("*").alias("n"))
    return p.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", "df", F.round(search.idf(F.col("df"), F.col("n")), 6).alias("idf"))  # n: one row


@query("inverted_index", f"SELECT t AS term, doc_id AS id, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS t FROM documents) GROUP BY 1, 2")
def inverted_index(spark, d):
    return search.postings(_t(spark, d, "documents")).select("term", "id", "tf")


_KW = f"SELECT doc_id, {KEY} AS w FROM documents"


def _kw_sql(have: str) -> str:
    hits = " + ".join(f"len(list_filter(w, lambda x: x = '{q}'))" for q in WORDS)
    return f"SELECT doc_id, round(({hits}) / len(w) / {len(WORDS)}, 6) AS score FROM ({_KW}) WHERE len(w) > 0 AND {have}"


query("keyword_or", _kw_sql(" OR ".join(f"list_contains(w, '{q}')" for q in WORDS).join("()")))(lambda s, d: search.keyword_search(_t(s, d, "documents"), WORDS).select("doc_id", _r()))
query("keyword_and", _kw_sql(" AND ".join(f"list_contains(w, '{q}')" for q in WORDS)))(lambda s, d: search.keyword_search(_t(s, d, "documents"), WORDS, True).select("doc_id", _r()))


@query("keyword_table_retrieve", f"SELECT doc_id, score FROM ({_kw_sql(' OR '.join(f'list_contains(w, {q!r})' for q in WORDS).join('()'))}) WHERE score >= 0.0005 ORDER BY score DESC, doc_id LIMIT 100")
def keyword_table_retrieve(spark, d):
    return search.keyword_search(_t(spark, d, "documents"), WORDS).select("doc_id", _r()).filter("score >= 0.0005").orderBy(F.desc("score"), "doc_id").limit(100)


@query("keyword_stats", f"WITH p AS (SELECT doc_id, unnest({KEY}) AS t FROM documents) SELECT t AS keyword, count(*) AS total, count(DISTINCT doc_id) AS nodes FROM p GROUP BY t")
def keyword_stats(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.explode(T.keywords(F.col("text"))).alias("keyword"))
    return rows.groupBy("keyword", "doc_id").agg(F.count("*").alias("n")).groupBy("keyword").agg(F.sum("n").alias("total"), F.count("*").alias("nodes"))


@query("summary_retrieve", "SELECT doc_id, round((" + " + ".join(f"CASE WHEN list_contains(w, '{q}') THEN 1 ELSE 0 END" for q in ["the", "thand", "thand", "ersh"]) + f") / 4, 6) AS score FROM (SELECT doc_id, {WS.format('lower(text)')} AS w FROM documents) WHERE list_has_any(w, ['the', 'thand', 'ersh'])")
def summary_retrieve(spark, d):
    s = search.summary_score(["the", "thand", "thand", "ersh"], F.col("text"))
    return _t(spark, d, "documents").select("doc_id", s.alias("score")).filter("score > 0").select("doc_id", _r())


def _lists(spark, d):
    e, q = _t(spark, d, "embeddings"), _q(spark, d)
    a = search.knn(e, q, 20).select(F.lit(0).alias("list_id"), F.col("vec_id").alias("id"), "score")
    return a.union(search.knn(e, q, 20, metric="manhattan").select(F.lit(1), "vec_id", "score"))


_LISTS = f"""WITH q AS (SELECT {QV} AS v), l AS (
 SELECT * FROM (SELECT 0 AS list_id, vec_id AS id, {SIM['cosine']} AS score FROM embeddings, q ORDER BY score DESC, id LIMIT 20)
 UNION ALL SELECT * FROM (SELECT 1 AS list_id, vec_id AS id, {SIM['manhattan']} AS score FROM embeddings, q ORDER BY score DESC, id LIMIT 20)),
 m AS (SELECT *, CASE list_id WHEN 0 THEN 0.7 ELSE 0.3 END::DOUBLE AS w, min(score) OVER (PARTITION BY list_id) AS lo, max(score) OVER (PARTITION BY list_id) AS hi,
 avg(score) OVER (PARTITION BY list_id) AS mu, greatest(stddev_pop(score) OVER (PARTITION BY list_id), 1e-6) AS sd FROM l),
 n AS (SELECT *, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE score END AS s FROM m) """
_FUSED = {
    "fusion_rrf": (lambda x: fusion.rrf(x), "SELECT id, round(sum(1 / (r + 60.0)), 6) AS score FROM (SELECT id, row_number() OVER (PARTITION BY list_id ORDER BY score DESC, id) - 1 AS r FROM l) GROUP BY id"),
    "fusion_weighted": (lambda x: fusion.weighted_average(x, [0.7, 0.3]), "SELECT id, round(sum(w * s) / sum(w), 6) AS score FROM n GROUP BY id"),
    "fusion_linear": (lambda x: fusion.linear(x, [0.7, 0.3]), "SELECT id, round(sum(w * s), 6) AS score FROM n GROUP BY id"),
    "fusion_dbsf": (lambda x: fusion.distribution_based(x, [0.7, 0.3]), "SELECT id, round(sum(w / (1 + exp(-(score - mu) / sd))), 6) AS score FROM n GROUP BY id"),
    "fusion_concat": (lambda x: fusion.concat(x), "SELECT id, round(arg_min(score, list_id), 6) AS score FROM l GROUP BY id"),
    "fusion_dist": (lambda x: fusion.distance_based(x, [0.7, 0.3]), "SELECT id, round(arg_min(w / (1 + score), list_id), 6) AS score FROM n GROUP BY id"),
    "fusion_keep_max": (lambda x: fusion.keep_max(x), "SELECT id, round(max(score), 6) AS score FROM l GROUP BY id"),
    "fusion_average": (lambda x: fusion.keep(x, "average"), "SELECT id, round(avg(score), 6) AS score FROM l GROUP BY id"),
    "fusion_minimum": (lambda x: fusion.keep(x, "minimum"), "SELECT id, round(min(score), 6) AS score FROM l GROUP BY id"),
}
for _name, (_f, _s) in _FUSED.items():
    query(_name, _LISTS + _s)(lambda s, d, f=_f: f(_lists(s, d)).select("id", _r()))
query("vote_fusion", _LISTS + "SELECT id, count(*) AS votes, round(arg_min(score, list_id), 6) AS score FROM l GROUP BY id")(lambda s, d: fusion.votes(_lists(s, d)).select("id", "votes", _r()))
query("norm_minmax", _LISTS + "SELECT list_id, id, round(s, 6) AS score FROM n")(lambda s, d: fusion.min_max(_lists(s, d)).select("list_id", "id", _r()))
query("norm_zscore", _LISTS + "SELECT list_id, id, round((score - mu) / sd, 6) AS score FROM n")(lambda s, d: fusion.z_score(_lists(s, d)).select("list_id", "id", _r()))


@query("hybrid_alpha", _LISTS + "SELECT id, round(0.6 * coalesce(max(score) FILTER (WHERE list_id = 0), 0) + 0.4 * coalesce(max(score) FILTER (WHERE list_id = 1), 0), 6) AS score FROM l GROUP BY id ORDER BY score DESC, id LIMIT 10")
def hybrid_alpha(spark, d):
    x = _lists(spark, d)
    out = search.hybrid(x.filter("list_id = 0").select("id", "score"), x.filter("list_id = 1").select("id", "score"), 0.6)
    return out.select("id", _r()).orderBy(F.desc("score"), "id").limit(10)


# Filters.


def _docs_labels(spark, d):
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")


@query("filter_metadata_all", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND lang = 'en' AND toxic <> 1")
def filter_metadata_all(spark, d):
    return _docs_labels(spark, d).filter(filters.metadata_predicate({"quality": 1, "lang": "en"}, {"toxic": 1})).select("doc_id")


@query("filter_metadata_any", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 0 OR lang = 'fr'")
def filter_metadata_any(spark, d):
    return _docs_labels(spark, d).filter(filters.metadata_predicate({"quality": 0, "lang": "fr"}, require_all=False)).select("doc_id")


_EDGE = r"[^\p{L}\p{M}\p{N}_]"


def _word_sql(w: str) -> str:
    return f"regexp_matches(text, '(?i)(^|{_EDGE}){w}($|{_EDGE})')"


@query("filter_keyword", f"SELECT doc_id FROM documents WHERE ({_word_sql('thand')} OR {_word_sql('of the')}) AND NOT {_word_sql('heth')}")
def filter_keyword(spark, d):
    return _t(spark, d, "documents").filter(filters.keyword_predicate(F.col("text"), ["thand", "of the"], ["heth"])).select("doc_id")


@query("filter_length", "SELECT doc_id, strlen(text) AS bytes FROM documents WHERE strlen(text) BETWEEN 500 AND 5000")
def filter_length(spark, d):
    return _t(spark, d, "documents").filter(filters.content_length(F.col("text"), 500, 5000)).select("doc_id", F.octet_length("text").cast("long").alias("bytes"))


@query("filter_similarity", f"SELECT vec_id, rank, score FROM (SELECT vec_id, rank, round(score, 6) AS score FROM (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT vec_id, {SIM['cosine']} AS score FROM embeddings, (SELECT {QV} AS v) q ORDER BY score DESC, vec_id LIMIT 50))) WHERE score >= 0.1 ORDER BY rank LIMIT 20")
def filter_similarity(spark, d):
    hits = search.ranked(search.knn(_t(spark, d, "embeddings"), _q(spark, d), 50))
    return filters.similarity_cutoff(hits.select("vec_id", "rank", _r()), 0.1, 20)


@query("index_admission", "SELECT sha256(text) AS hash, min(doc_id) AS doc_id FROM documents WHERE strlen(text) >= 10 GROUP BY 1")
def index_admission(spark, d):
    return filters.admit(_t(spark, d, "documents")).select("hash", "doc_id")


# Splitting.


@query("sentence_window", f"""WITH s AS (SELECT doc_id, unnest(x) AS t, unnest(range(len(x))) AS i FROM (SELECT doc_id, {SENT} AS x FROM documents))
 SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, strlen(t) AS bytes, strlen(string_agg(t, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS window_bytes FROM s""")
def sentence_window(spark, d):
    x = splitters.sentence_windows(_t(spark, d, "documents"))
    return x.select("doc_id", "chunk_index", F.octet_length("original_text").cast("long").alias("bytes"), F.octet_length("window").cast("long").alias("window_bytes"))


def _chunks(docs, chunks):
    return splitters.to_nodes(docs, chunks, name="hash", value=F.md5).select("doc_id", "chunk_index", "node_id", "hash", "prev_id", "next_id")


def _chunk_sql(items: str) -> str:
    return f"""WITH c AS (SELECT doc_id, {items} AS c FROM (SELECT doc_id, text, {WS.format('text')} AS w FROM documents)),
 x AS (SELECT doc_id, unnest(c) AS content, unnest(range(len(c))) AS i FROM (SELECT doc_id, list_filter(c, lambda s: trim(s) <> '') AS c FROM c))
 SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, doc_id || '-' || i AS node_id, md5(content) AS hash,
 lag(doc_id || '-' || i) OVER (PARTITION BY doc_id ORDER BY i) AS prev_id, lead(doc_id || '-' || i) OVER (PARTITION BY doc_id ORDER BY i) AS next_id FROM x"""


query("char_window", _chunk_sql("list_transform(range(1, length(text) + 1, 462), lambda p: substring(text, p, 512))"))(lambda s, d: _chunks(_t(s, d, "documents"), splitters.char_windows(F.col("text"))))
query("token_window", _chunk_sql("list_transform(range(1, len(w) + 1, 80), lambda p: array_to_string(w[p : p + 99], ' '))"))(lambda s, d: _chunks(splitters.token_window_lists(_t(s, d, "documents"), 100, 20), "chunks"))
query("code_line_window", _chunk_sql("list_transform(range(1, len(string_split(text, chr(10))) + 1, 25), lambda p: array_to_string(string_split(text, chr(10))[p : p + 39], chr(10)))"))(lambda s, d: _chunks(splitters.line_window_lists(_t(s, d, "documents")), "chunks"))


@query("sentence_split")
def sentence_split(spark, d):
    return splitters.build_nodes(_t(spark, d, "documents"), lambda t: splitters.split_sentences(t, 128, 20))


@query("hierarchical_nodes")
def hierarchical_nodes(spark, d):
    return splitters.hierarchical(_t(spark, d, "documents"), (512, 128)).select("node_id", "parent_id", "doc_id", "level")


@query("html_sections")
def html_sections(spark, d):
    return splitters.split_with(_t(spark, d, "pages"), splitters.split_html, "page_id", "html", "array<struct<tag: string, content: string>>").select("page_id", "chunk_index", "chunk.tag", "chunk.content")


@query("markdown_sections")
def markdown_sections(spark, d):
    return splitters.split_with(_t(spark, d, "documents"), splitters.split_markdown, schema="array<struct<path: string, level: int, content: string>>").select("doc_id", "chunk_index", "chunk.path", "chunk.level")


# Enrichment.


@query("text_statistics", f"""SELECT doc_id, strlen(text) AS bytes, CAST(len(w) AS BIGINT) AS words, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines,
 CAST(len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p, ' ') <> '')) AS BIGINT) AS paragraphs,
 round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: strlen(x))) / len(w) ELSE 0 END, 6) AS avg_word_bytes FROM (SELECT doc_id, text, {WS.format('text')} AS w FROM documents)""")
def text_statistics(spark, d):
    x = _t(spark, d, "documents").select("doc_id", enrich.statistics(F.col("text")).alias("s"))
    return x.select("doc_id", "s.bytes", "s.words", "s.lines", "s.paragraphs", F.round("s.avg_word_bytes", 6).alias("avg_word_bytes"))


# DuckDB's word boundaries are ASCII: letters and digits of other scripts are made ASCII word characters first, which are in none of the classes but the e-mail's.
@query("regex_counts", r"""SELECT doc_id, len(regexp_extract_all(t, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b')) AS email,
 len(regexp_extract_all(text, 'https?://[^ \t\n\r\f\x0B\x{85}\p{Z}]+')) AS url, len(regexp_extract_all(t, '\b\d{3}[-.]?\d{3}[-.]?\d{4}\b')) AS phone,
 len(regexp_extract_all(t, '\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b')) AS date, len(regexp_extract_all(text, '```(.|\n)*?```|`[^`]+`')) AS code_block
 FROM (SELECT doc_id, text, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') AS t FROM documents)""")
def regex_counts(spark, d):
    return _t(spark, d, "documents").select("doc_id", enrich.structure(F.col("text")).alias("s")).select("doc_id", "s.*")


@query("title_extract", r"""SELECT doc_id, CASE WHEN starts_with(trim(l[1], ' '), '#') THEN trim(regexp_replace(trim(l[1], ' '), '^#+', ''), ' ')
 ELSE list_filter(list_transform(l, lambda x: trim(x, ' ')), lambda x: x <> '' AND strlen(x) <= 200)[1] END AS title FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def title_extract(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.title(F.col("text")).alias("title"))


@query("frequent_keywords", f"""WITH p AS (SELECT doc_id, w AS word, count(*) AS n FROM (SELECT doc_id, unnest({WS.format('lower(text)')}) AS w FROM documents)
 WHERE regexp_full_match(w, '\\p{{L}}+') AND strlen(w) > 3 GROUP BY 1, 2)
 SELECT doc_id, word, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS r FROM p) WHERE r <= 10 AND n > 1""")
def frequent_keywords(spark, d):
    return enrich.frequent_words(_t(spark, d, "documents"))


@query("lang_guess", "SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\\x{4E00}-\\x{9FFF}]', '', 'g')) > strlen(text) // 4 THEN 'zh' WHEN " + " + ".join(f"(strlen(low) - strlen(replace(low, '{w}', ''))) // {len(w)}" for w in T.ENGLISH_HINTS) + " > 5 THEN 'en' END AS guess FROM (SELECT doc_id, text, lower(text) AS low FROM documents)")
def lang_guess(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.language_guess(F.col("text")).alias("guess"))


@query("content_type", r"""SELECT doc_id, CASE WHEN regexp_matches(text, '```(.|\n)*?```|`[^`]+`') OR regexp_matches(text, '(^|\n)[\s\x0B\x{85}\p{Z}]*(def |function |class )') THEN 'code'
 WHEN contains(text, '# ') OR contains(text, '*') THEN 'markdown' WHEN contains(low, 'json') AND (contains(text, '{') OR contains(text, '[')) THEN 'json'
 WHEN contains(text, '<') AND contains(text, '>') THEN 'html' WHEN contains(low, 'abstract') OR contains(low, 'introduction') OR contains(low, 'methodology') OR contains(low, 'conclusion') THEN 'academic'
 WHEN contains(low, 'api') OR contains(low, 'documentation') OR contains(low, 'readme') THEN 'documentation' ELSE 'text' END AS kind FROM (SELECT doc_id, text, lower(text) AS low FROM documents)""")
def content_type(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.content_type(F.col("text")).alias("kind"))


@query("text_features", f"""SELECT doc_id, round(len(regexp_extract_all(text, '[ \\t\\n\\r\\f\\x0B]')) / greatest(length(text), 1), 6) AS space_ratio,
 round(len(regexp_extract_all(text, '[!-/:-@\\[-`{{-~]')) / greatest(length(text), 1), 6) AS punct_ratio, round(len({WS.format('text')}) / 225.0, 6) AS reading_minutes FROM documents""")
def text_features(spark, d):
    x = _t(spark, d, "documents").select("doc_id", enrich.text_features(F.col("text")).alias("f"))
    return x.select("doc_id", *[F.round(f"f.{c}", 6).alias(c) for c in ("space_ratio", "punct_ratio", "reading_minutes")])


@query("url_parts", r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages")
def url_parts(spark, d):
    return _t(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.parse_url("url", F.lit("HOST")).alias("host"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("entity_counts")
def entity_counts(spark, d):
    x = _t(spark, d, "documents").select("doc_id", F.explode(enrich.entities(F.col("text"))).alias("e"))
    return x.groupBy("doc_id", "e.label").agg(F.count("*").alias("n"))


@query("query_classify", """SELECT item_id, CASE WHEN contains(t, 'summary') OR contains(t, 'overview') THEN 'summary' WHEN contains(t, 'code') OR contains(t, 'implement') THEN 'code_specific'
 WHEN contains(t, 'how') OR contains(t, 'detail') THEN 'detailed' ELSE 'summary' END AS kind, CASE WHEN strlen(t) > 100 THEN 4 WHEN strlen(t) > 50 THEN 3 ELSE 2 END AS complexity FROM (SELECT item_id, lower(text) AS t FROM benchmark)""")
def query_classify(spark, d):
    return _t(spark, d, "benchmark").select("item_id", T.query_class(F.col("text")).alias("q")).select("item_id", F.col("q.type").alias("kind"), "q.complexity")


@query("file_sizes", "SELECT doc_id, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KB', round(n / 1024, 1)) ELSE printf('%.1f MB', round(n / 1048576, 1)) END AS size FROM (SELECT doc_id, strlen(text) AS n FROM documents)")
def file_sizes(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.format_file_size(F.octet_length("text")).alias("size"))


@query("content_ids", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, base64(encode(substring(text, 1, 8))) AS head FROM documents")
def content_ids(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), F.base64(F.substring("text", 1, 8).cast("binary")).alias("head"))


# Dedup.

_HASH = r"sha256(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '[ \t\n\r\f\x0B]', ' ', 'g'))"


@query("dedup_hash", f"SELECT {_HASH} AS hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def dedup_hash(spark, d):
    return dedup.by_content(_t(spark, d, "documents"))


@query("dedup_upsert_status", f"""WITH h AS (SELECT doc_id, source, {_HASH} AS hash FROM documents),
 k AS (SELECT doc_id + 1 AS doc_id, hash AS old FROM h WHERE source <> 'src0' UNION ALL SELECT doc_id, hash FROM h WHERE doc_id + 1 IN (SELECT doc_id FROM h WHERE source = 'src0') AND doc_id - 1 NOT IN (SELECT doc_id FROM h WHERE source <> 'src0'))
 SELECT h.doc_id, CASE WHEN old IS NULL THEN 'process' WHEN old = hash THEN 'skip' ELSE 'update' END AS status FROM h LEFT JOIN k USING (doc_id)""")
def dedup_upsert_status(spark, d):
    """Known hashes: each document's predecessor's, where it is not of src0; else its own, where its successor is of src0."""
    docs = _t(spark, d, "documents").select("doc_id", "source", "text")
    own = docs.select("doc_id", "source", T.document_hash(F.col("text")).alias("hash"))
    shifted = own.filter("source <> 'src0'").select((F.col("doc_id") + 1).alias("doc_id"), "hash")
    before = own.filter("source = 'src0'").select((F.col("doc_id") - 1).alias("doc_id"))
    same = own.join(before, "doc_id", "left_semi").join(shifted.select("doc_id"), "doc_id", "left_anti").select("doc_id", "hash")
    return dedup.status(docs, shifted.union(same)).select("doc_id", "status")


@query("hash_antijoin", "SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0')")
def hash_antijoin(spark, d):
    x = _t(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    return dedup.unseen(x, x.filter("source = 'src0'").select("hash").distinct()).select("doc_id")


@query("best_per_label", f"SELECT label, vec_id, round(score, 6) AS score FROM (SELECT label, vec_id, {SIM['cosine']} AS score, row_number() OVER (PARTITION BY label ORDER BY {SIM['cosine']} DESC, vec_id) AS r FROM embeddings, (SELECT {QV} AS v) q) WHERE r = 1")
def best_per_label(spark, d):
    hits = search.scored(_t(spark, d, "embeddings"), _q(spark, d))
    return dedup.best_per(hits, ["label"], "vec_id").select("label", "vec_id", _r())


@query("jaccard_rerank", f"""SELECT doc_id, round(len(list_intersect(w, q)) / len(list_distinct(list_concat(w, q))), 6) AS score FROM
 (SELECT doc_id, list_distinct({TOK}) AS w FROM documents), (SELECT {LIT} AS q)""")
def jaccard_rerank(spark, d):
    return dedup.jaccard_to(_t(spark, d, "documents"), TERMS).select("doc_id", _r())


@query("diversity_rerank")
def diversity_rerank(spark, d):
    hits = search.bm25(_t(spark, d, "documents"), TERMS, 50).join(_t(spark, d, "documents"), "doc_id").select(F.lit(0).alias("qid"), "doc_id", "score", F.array_distinct(T.whitespace_words(F.col("text"))).alias("words"))
    return dedup.diversity(hits, ["qid"], "doc_id", "words").select("rank", "doc_id", "score")


@query("dedup_text_similarity")
def dedup_text_similarity(spark, d):
    hits = search.bm25(_t(spark, d, "documents"), TERMS, 50).join(_t(spark, d, "documents"), "doc_id").select(F.lit(0).alias("qid"), "doc_id", "score", F.array_distinct(T.terms(F.col("text"))).alias("words"))
    return dedup.greedy(hits, ["qid"], "doc_id", "words").select("doc_id", "score")


@query("sentence_optimizer", None)
def sentence_optimizer(spark, d):
    hits = search.bm25(_t(spark, d, "documents"), TERMS, 20).join(_t(spark, d, "documents"), "doc_id").select("doc_id", "score", "text")
    return filters.sentence_optimizer(hits, TERMS)


# Hierarchy: customers under nations under regions.


def _tree(spark, d):
    r = _t(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"))
    n = _t(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "n_regionkey"))
    c = _t(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey"), F.concat(F.lit("N"), "c_nationkey"))
    return r.union(n).union(c)


_TREE = """WITH t AS (SELECT 'R' || r_regionkey AS node_id, NULL AS parent_id FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
 UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer) """
query("leaf_nodes", _TREE + "SELECT node_id FROM t WHERE node_id NOT IN (SELECT parent_id FROM t WHERE parent_id IS NOT NULL)")(lambda s, d: hierarchy.leaves(_tree(s, d)).select("node_id"))
query("root_nodes", _TREE + "SELECT node_id FROM t WHERE parent_id IS NULL")(lambda s, d: hierarchy.roots(_tree(s, d)).select("node_id"))
query("deep_nodes", _TREE + "SELECT a.node_id FROM t a JOIN t b ON a.parent_id = b.node_id WHERE b.parent_id IS NOT NULL")(lambda s, d: hierarchy.deeper_than(_tree(s, d), 1).select("node_id"))
query("child_count", _TREE + "SELECT parent_id, count(*) AS child_count FROM t WHERE parent_id IS NOT NULL GROUP BY 1")(lambda s, d: hierarchy.child_counts(_tree(s, d)).select("parent_id", "child_count"))


@query("auto_merge", _TREE + """, h AS (SELECT 'C' || c_custkey AS node_id, c_acctbal AS score, 'N' || c_nationkey AS parent FROM customer WHERE c_acctbal > 4500),
 k AS (SELECT parent_id, count(*) AS k FROM t WHERE parent_id IS NOT NULL GROUP BY 1),
 m1 AS (SELECT parent AS node_id, avg(score) AS score FROM h GROUP BY parent HAVING count(*) / (SELECT k FROM k WHERE parent_id = parent) > 0.5),
 s1 AS (SELECT node_id, score FROM h WHERE parent NOT IN (SELECT node_id FROM m1) UNION ALL SELECT * FROM m1),
 p AS (SELECT s1.*, t.parent_id AS parent FROM s1 JOIN t USING (node_id)),
 m2 AS (SELECT parent AS node_id, avg(score) AS score FROM p WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) / (SELECT k FROM k WHERE parent_id = parent) > 0.5)
 SELECT node_id, round(score, 4) AS score FROM (SELECT node_id, score FROM p WHERE parent IS NULL OR parent NOT IN (SELECT node_id FROM m2) UNION ALL SELECT * FROM m2)""")
def auto_merge(spark, d):
    hits = _t(spark, d, "customer").filter("c_acctbal > 4500").select(F.concat(F.lit("C"), "c_custkey").alias("node_id"), F.col("c_acctbal").alias("score"))
    return hierarchy.auto_merge(hits, _tree(spark, d)).select("node_id", F.round("score", 4).alias("score"))


@query("segment_extract", f"""WITH s AS (SELECT doc_id, unnest(x) AS t, unnest(range(len(x))) AS i FROM (SELECT doc_id, {SENT} AS x FROM documents)),
 h AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM s WHERE strlen(t) > 40),
 p AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, island ORDER BY i) - 1) // 5 AS piece FROM h)
 SELECT doc_id, CAST(min(i) AS INTEGER) AS first, CAST(max(i) AS INTEGER) AS last, count(*) AS n FROM p GROUP BY doc_id, island, piece""")
def segment_extract(spark, d):
    s = _t(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("chunk_index", "t")).filter(F.octet_length("t") > 40)
    return hierarchy.segments(s.withColumn("score", F.lit(1.0))).drop("score")


# Graph: suppliers and customers in nations in regions.


def _graph(spark, d):
    parts = [("R", "region", "r_regionkey", "r_name", None, "Region"), ("N", "nation", "n_nationkey", "n_name", ("R", "n_regionkey"), "Nation"), ("S", "supplier", "s_suppkey", "s_name", ("N", "s_nationkey"), "Supplier"), ("C", "customer", "c_custkey", "c_name", ("N", "c_nationkey"), "Customer")]
    v = e = None
    for sign, table, key, name, up, label in parts:
        rows = _t(spark, d, table)
        own = rows.select(F.concat(F.lit(sign), key).alias("id"), F.col(name).alias("name"), F.lit(label).alias("label"))
        v = own if v is None else v.union(own)
        if up:
            own = rows.select(F.concat(F.lit(sign), key).alias("source"), F.lit("LOCATED_IN").alias("label"), F.concat(F.lit(up[0]), up[1]).alias("target"))
            e = own if e is None else e.union(own)
    return v, e


_GRAPH = """WITH v AS (SELECT 'R' || r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation
 UNION ALL SELECT 'S' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'C' || c_custkey, c_name FROM customer),
 e AS (SELECT 'N' || n_nationkey AS source, 'LOCATED_IN' AS label, 'R' || n_regionkey AS target FROM nation UNION ALL SELECT 'S' || s_suppkey, 'LOCATED_IN', 'N' || s_nationkey FROM supplier
 UNION ALL SELECT 'C' || c_custkey, 'LOCATED_IN', 'N' || c_nationkey FROM customer) """


@query("triplets_filtered", _GRAPH + "SELECT source, label, target, a.name AS source_name, b.name AS target_name FROM e JOIN v a ON source = a.id JOIN v b ON target = b.id WHERE label = 'LOCATED_IN' AND (source IN ('N1', 'R2', 'S3') OR target IN ('N1', 'R2', 'S3'))")
def triplets_filtered(spark, d):
    v, e = _graph(spark, d)
    return graph.matching(graph.triplets(v, e.withColumnRenamed("label", "label")), relations=["LOCATED_IN"], ids=["N1", "R2", "S3"]).select("source", "label", "target", "source_name", "target_name")


@query("graph_two_hop", _GRAPH + """, b AS (SELECT source, target FROM e UNION SELECT target, source FROM e), h1 AS (SELECT DISTINCT target AS id FROM b WHERE source = 'R1'),
 h2 AS (SELECT DISTINCT target AS id FROM b JOIN h1 ON source = h1.id WHERE target NOT IN (SELECT id FROM h1) AND target <> 'R1')
 SELECT 'R1' AS id, 0 AS hops UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""")
def graph_two_hop(spark, d):
    v, e = _graph(spark, d)
    return graph.k_hop(e, v.filter("id = 'R1'"))


@query("graph_degrees", _GRAPH + "SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id")
def graph_degrees(spark, d):
    return graph.degrees(_graph(spark, d)[1])


@query("graph_score", _GRAPH + """, x AS (SELECT a.name || ' located in ' || b.name AS text, contains('which nation is in asia', lower(a.name)) OR contains('which nation is in asia', lower(b.name)) AS named FROM e JOIN v a ON source = a.id JOIN v b ON target = b.id),
 y AS (SELECT text, named, list_distinct(string_split(lower(text), ' ')) AS w, ['asia', 'in', 'is', 'nation', 'which'] AS q FROM x)
 SELECT text, round(max(CASE WHEN named THEN 0.4 ELSE 0 END + 0.3 + 0.3 * len(list_intersect(w, q)) / len(list_distinct(list_concat(w, q)))), 6) AS score FROM y GROUP BY text""")
def graph_score(spark, d):
    v, e = _graph(spark, d)
    return graph.scored_triplets(graph.triplets(v, e), "which nation is in ASIA", {"LOCATED_IN": ["in", "located"]}).select("text", _r())


# Conversations.
_CTOK = "CAST(ceil(strlen(text) / 4) + 2 AS BIGINT)"


@query("chat_recent", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def chat_recent(spark, d):
    return chat.recent(_t(spark, d, "conversations"), 3).select("conv_id", "turn", "role", "text")


query("chat_by_role", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")(lambda s, d: chat.by_role(_t(s, d, "conversations"), "user").select("conv_id", "turn", "text"))
query("chat_token_stats", f"SELECT role, count(*) AS n, CAST(sum({_CTOK}) AS BIGINT) AS tokens FROM conversations GROUP BY role")(lambda s, d: chat.stats(_t(s, d, "conversations")))


@query("chat_truncate", f"""WITH a AS (SELECT *, {_CTOK} AS tok, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
 b AS (SELECT *, role = 'system' OR back <= 2 AS fixed FROM a),
 c AS (SELECT *, sum(CASE WHEN fixed THEN tok ELSE 0 END) OVER (PARTITION BY conv_id) AS ft, sum(CASE WHEN fixed THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS fn,
 sum(CASE WHEN fixed THEN 0 ELSE tok END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS t, sum(CASE WHEN fixed THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS n FROM b)
 SELECT conv_id, turn, role FROM c WHERE fixed OR (ft + t <= 200 AND fn + n <= 5)""")
def chat_truncate(spark, d):
    return chat.truncated(_t(spark, d, "conversations"), 200, 5).select("conv_id", "turn", "role")


@query("chat_prompt", "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6 GROUP BY conv_id")
def chat_prompt(spark, d):
    return chat.window_prompt(_t(spark, d, "conversations")).select("conv_id", F.md5("prompt").alias("prompt"))


# Statistics.


@query("index_stats", "SELECT source, count(*) AS nodes, CAST(sum(strlen(text)) AS BIGINT) AS total, round(avg(strlen(text)), 6) AS mean, count(DISTINCT doc_id) AS docs FROM documents GROUP BY source")
def index_stats(spark, d):
    n = F.octet_length("text")
    return _t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("nodes"), F.sum(n).alias("total"), F.round(F.avg(n), 6).alias("mean"), F.count_distinct("doc_id").alias("docs"))


@query("monitor_trailing", "SELECT event_id, n, round(mean, 6) AS mean FROM (SELECT event_id, count(*) OVER w AS n, avg(value) OVER w AS mean FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW))")
def monitor_trailing(spark, d):
    e = _t(spark, d, "events").select("event_id", "event_type", "ts", "value")
    # As the SQL rounds: Spark's round() to 6 places goes by a double's decimal digits.
    return ingest.trailing(e, 3600).select("event_id", "n", (F.round(F.col("mean") * 1e6) / 1e6).alias("mean"))


@query("extension_daily_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def daily_windows(spark, d):
    return ingest.windowed(_t(spark, d, "events")).select(F.col("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("response_cost", f"SELECT conv_id, round(sum(CASE WHEN role = 'assistant' THEN {_CTOK} ELSE 0 END) / 1000 * 0.03 + sum(CASE WHEN role <> 'assistant' THEN {_CTOK} ELSE 0 END) / 1000 * 0.01, 8) AS cost FROM conversations GROUP BY conv_id")
def response_cost(spark, d):
    tok, own = chat.tokens(F.col("text")), F.col("role") == "assistant"
    return _t(spark, d, "conversations").groupBy("conv_id").agg(F.round(F.sum(F.when(own, tok).otherwise(0)) / 1000 * 0.03 + F.sum(F.when(own, 0).otherwise(tok)) / 1000 * 0.01, 8).alias("cost"))


@query("confidence", f"SELECT label, round(greatest(0, least(1, avg({SIM['cosine']}))), 6) AS confidence FROM embeddings, (SELECT {QV} AS v) q GROUP BY label")
def confidence(spark, d):
    s = search.scored(_t(spark, d, "embeddings"), _q(spark, d))
    return s.groupBy("label").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("score"))), 6).alias("confidence"))


@query("rgb_to_hsv", "SELECT p_partkey, round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 6) AS gray, round(greatest(r, g, b) / 255, 6) AS v, round(CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) / 255 - least(r, g, b) / 255) / (greatest(r, g, b) / 255) END, 6) AS s, round(CASE WHEN greatest(r, g, b) = least(r, g, b) THEN 0 WHEN greatest(r, g, b) = r THEN 60 * (CASE WHEN g >= b THEN (g - b) / (r - least(g, b)) ELSE 6 + (g - b) / (r - least(g, b)) END) WHEN greatest(r, g, b) = g THEN 60 * ((b - r) / (g - least(r, b)) + 2) ELSE 60 * ((r - g) / (b - least(r, g)) + 4) END, 6) AS h FROM (SELECT p_partkey, p_partkey % 256 AS r, p_size * 5 % 256 AS g, p_partkey * 7 % 256 AS b FROM part)")
def rgb_to_hsv(spark, d):
    x = _t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 256).alias("r"), (F.col("p_size") * 5 % 256).alias("g"), (F.col("p_partkey") * 7 % 256).alias("b"))
    h = M.hsv(F.col("r"), F.col("g"), F.col("b"))
    return x.select("p_partkey", F.round(M.gray(F.col("r"), F.col("g"), F.col("b")), 6).alias("gray"), F.round(h["v"], 6).alias("v"), F.round(h["s"], 6).alias("s"), F.round(h["h"], 6).alias("h"))


@query("synonym_expand", "WITH s AS (SELECT * FROM (VALUES ('the', 'that'), ('the', 'this'), ('of', 'from')) t(w, x)), q AS (SELECT item_id, unnest(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\x0B]+')) AS w FROM benchmark) SELECT item_id, x AS term, count(*) AS n FROM q JOIN s USING (w) GROUP BY 1, 2")
def synonym_expand(spark, d):
    s = spark.createDataFrame([("the", "that"), ("the", "this"), ("of", "from")], "w string, term string")
    q = _t(spark, d, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("w"))
    return q.join(s, "w").groupBy("item_id", "term").agg(F.count("*").alias("n"))


@query("rank_columns", f"SELECT vec_id, rank FROM (SELECT vec_id, row_number() OVER (ORDER BY {SIM['dot']} DESC, vec_id) AS rank FROM embeddings, (SELECT {QV} AS v) q) WHERE rank <= 25")
def rank_columns(spark, d):
    return search.ranked(search.knn(_t(spark, d, "embeddings"), _q(spark, d), 25, metric="dot")).select("vec_id", "rank")



@query("node_uuids", """WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(doc_id || '-0')) AS h FROM documents)
 SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS node_id FROM h""")
def node_uuids(spark, d):
    return _t(spark, d, "documents").select("doc_id", splitters.node_uuid(F.concat(F.col("doc_id").cast("string"), F.lit("-0"))).alias("node_id"))


@query("fusion_rank_score", _LISTS + "SELECT list_id, id, round((count(*) OVER (PARTITION BY list_id) - row_number() OVER (PARTITION BY list_id ORDER BY score DESC, id) + 1) / count(*) OVER (PARTITION BY list_id), 6) AS score FROM l")
def fusion_rank_score(spark, d):
    return fusion.rank_score(_lists(spark, d)).select("list_id", "id", _r())


@query("adjacent_dedup", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def adjacent_dedup(spark, d):
    return dedup.adjacent(_t(spark, d, "events"), ["user_id"], "event_id", ["event_type"]).select("event_id")


@query("rerank_ascending", f"SELECT vec_id, round({SIM['cosine']}, 6) AS score FROM embeddings, (SELECT {QV} AS v) q ORDER BY {SIM['cosine']}, vec_id LIMIT 10")
def rerank_ascending(spark, d):
    return search.reranked(search.scored(_t(spark, d, "embeddings"), _q(spark, d)), "asc", 10, "vec_id").select("vec_id", _r())


@query("plain_keywords", f"SELECT doc_id, CAST(len({TOK.replace('>= 2', '>= 3')}) AS BIGINT) AS n FROM documents")
def plain_keywords(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(T.plain_keywords(F.col("text"))).cast("long").alias("n"))


@query("token_split")
def token_split(spark, d):
    return splitters.build_nodes(_t(spark, d, "documents"), lambda t: splitters.split_tokens(t, 128, 20)).drop("content")
