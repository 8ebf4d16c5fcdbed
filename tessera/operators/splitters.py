"""Splitters: one document to n nodes.

Fixed windows are native. Greedy splitters look at the previous chunk to make
the next one, so they run over Arrow batches, one document at a time.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions import text as T

# Native windows.


def char_windows(c: Column, size: int = 512, overlap: int = 50) -> Column:
    """Windows of `size` code points, each `size - overlap` after the last."""
    n = F.char_length(c)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n, F.lit(size - overlap)), lambda p: F.substr(c, p, F.lit(size))))


def _windows(docs: DataFrame, pieces: Column, size: int, overlap: int, joint: str, keep: list) -> DataFrame:
    """The columns `keep`, pieces and chunks of each row: every size - overlap pieces a window of `size`.

    Takes time in proportion to the windows' pieces, as a window reads its own
    by position; nothing is shuffled.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap is from 0 to less than size")
    rows = docs.select(*keep, F.explode(F.array(pieces)).alias("pieces"))  # a generator, as the plan would put a mere projection into the lambda, once for each piece
    n = F.size("pieces")

    def window(p):
        return F.array_join(F.transform(F.sequence(p, F.least(p + size, n) - 1), lambda i: F.get("pieces", i)), joint)

    chunks = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(size - overlap)), window))
    return rows.select(*keep, "pieces", chunks.alias("chunks"))


def _window_rows(docs: DataFrame, pieces: Column, size: int, overlap: int, joint: str, id_col: str) -> DataFrame:
    """id, chunk_index and content; repeated rows give their windows once."""
    rows = _windows(docs, pieces, size, overlap, joint, [id_col]).select(id_col, F.xxhash64("pieces").alias("of"), F.posexplode("chunks").alias("chunk_index", "content"))
    return rows.distinct().drop("of")


def token_windows(docs: DataFrame, size: int = 1000, overlap: int = 200, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of `size` white-space tokens, joined by a space: id, chunk_index, content."""
    return _window_rows(docs, T.whitespace_words(F.col(text)), size, overlap, " ", id_col)


def line_windows(docs: DataFrame, lines: int = 40, overlap: int = 15, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of lines, for code without a parser: id, chunk_index, content."""
    return _window_rows(docs, F.split(text, "\n"), lines, overlap, "\n", id_col)


def token_window_lists(docs: DataFrame, size: int = 1000, overlap: int = 200, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The windows of token_windows() as an array `chunks` of each row, for to_nodes()."""
    return _windows(docs, T.whitespace_words(F.col(text)), size, overlap, " ", [id_col]).drop("pieces")


def line_window_lists(docs: DataFrame, lines: int = 40, overlap: int = 15, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The windows of line_windows() as an array `chunks` of each row, for to_nodes()."""
    return _windows(docs, F.split(text, "\n"), lines, overlap, "\n", [id_col]).drop("pieces")


def to_nodes(docs: DataFrame, chunks: Column, id_col: str = "doc_id", name: str = "content", value=None) -> DataFrame:
    """One row for each non-blank chunk: doc_id, chunk_index, node_id, content, prev_id, next_id.

    value: what is kept of a content, as its hash, before nodes are linked; texts are not shuffled then.
    """
    rows = docs.select(id_col, F.posexplode(F.filter(chunks, lambda x: F.trim(x) != "")).alias("chunk_index", name))
    if value is not None:
        rows = rows.withColumn(name, value(F.col(name)))
    return linked(rows, id_col)


def chunk_nodes(chunks: DataFrame, id_col: str = "doc_id", name: str = "content") -> DataFrame:
    """Chunks that are rows already (id, chunk_index, content) as nodes: blank ones dropped, the rest numbered anew."""
    rows = chunks.filter(F.trim(name) != "")
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy("chunk_index")) - 1
    return linked(rows.withColumn("chunk_index", nth.cast("int")), id_col)


def linked(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of id and chunk_index with node_id, and the nodes before and after."""
    rows = rows.withColumn("node_id", F.concat_ws("-", F.col(id_col), F.col("chunk_index")))
    w = Window.partitionBy(id_col).orderBy("chunk_index")
    return rows.withColumn("prev_id", F.lag("node_id").over(w)).withColumn("next_id", F.lead("node_id").over(w))


def sentence_windows(docs: DataFrame, w: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A node for each sentence, with its w neighbours on each side as `window`."""
    s = docs.select(id_col, F.posexplode(T.sentences(F.col(text))).alias("chunk_index", "original_text"))
    by = Window.partitionBy(id_col).orderBy("chunk_index").rowsBetween(-w, w)
    return s.withColumn("window", F.array_join(F.collect_list("original_text").over(by), " "))


def semantic_chunks(sentences: DataFrame, percentile: float = 95, doc: str = "doc_id", pos: str = "chunk_index", vector: str = "embedding", text: str = "original_text") -> DataFrame:
    """Sentences joined until the distance to the next is over the value at floor(p/100*n) of the sorted distances."""
    from tessera.functions.vector import cosine

    by = Window.partitionBy(doc).orderBy(pos)
    x = sentences.withColumn("_d", 1 - cosine(F.col(vector), F.lead(vector).over(by)))
    all_ = F.array_sort(F.collect_list("_d").over(Window.partitionBy(doc)))
    x = x.withColumn("_all", all_).withColumn("_cut", F.get(F.col("_all"), F.least(F.floor(percentile / 100 * F.size("_all")).cast("int"), F.size("_all") - 1)))
    x = x.withColumn("_break", F.coalesce(F.lag((F.col("_d") > F.col("_cut")).cast("int")).over(by), F.lit(0)))
    x = x.withColumn("chunk", F.sum("_break").over(by))
    return x.groupBy(doc, "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, F.col(text).alias("t")))), lambda r: r["t"]), " ").alias("content"))


# Greedy splitters.

_GAP = re.compile(r"[.!?]+\s+")


def _cascade(text: str, most: int) -> list[str]:
    """Pieces of at most `most` white-space tokens, cut at the coarsest separator that does."""
    if len(text.split()) <= most:
        return [text]
    for sep in ("\n\n\n", "\n\n", "\n", None, " ", ""):
        if sep is None:
            cuts = [m.end() for m in _GAP.finditer(text)]
            parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        elif sep:
            parts = text.split(sep)
        else:
            return list(text)
        parts = [p for p in parts if p.strip()]
        if len(parts) > 1:
            return [x for p in parts for x in _cascade(p, most)]
    return [text]


def split_sentences(text: str | None, size: int = 1000, overlap: int = 200) -> list[str]:
    """Greedy chunks of at most `size` tokens; each begins with the last pieces of the one before, up to `overlap` tokens."""
    if size < 1 or overlap < 0 or overlap > size:
        raise ValueError("size is at least 1 and overlap from 0 to size")
    out, own, n = [], [], 0
    for piece in _cascade(text or "", size):
        k = len(piece.split())
        if own and n + k > size:
            out.append(" ".join(p.strip() for p in own))
            back, m = [], 0
            for p in reversed(own):
                if m + len(p.split()) > overlap:
                    break
                back.insert(0, p)
                m += len(p.split())
            own, n = back, m
        own.append(piece)
        n += k
    if own:
        out.append(" ".join(p.strip() for p in own))
    return [x for x in out if x.strip()]


def split_tokens(text: str | None, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = (" ", "\n")) -> list[str]:
    """Greedy chunks of at most `size` white-space tokens, cut at the first separator that is in the text, else between characters.

    Pieces keep the separator that ends them, so chunks are stretches of the
    text; each begins with the last pieces of the one before, up to `overlap`
    tokens. A piece that is too long is split by itself.
    """
    if size < 1 or not 0 <= overlap <= size:
        raise ValueError("size is at least 1 and overlap from 0 to size")
    out: list[str] = []
    stack = [text or ""]
    while stack:
        own = stack.pop()
        if len(own.split()) <= size:
            if own.strip():
                out.append(own)
            continue
        sep = next((x for x in separators if x in own[:-1]), None)
        pieces = [x for x in (re.findall(f"[^{re.escape(sep)}]*{re.escape(sep)}|[^{re.escape(sep)}]+$", own) if sep else own) if x.strip()]
        held: list[tuple[str, int]] = []
        n = 0
        for k, piece in enumerate(pieces):
            m = len(piece.split())
            if m > size:
                if held:
                    out.append("".join(x for x, _ in held))
                stack += ["".join(pieces[k + 1 :]), piece]
                held = []
                break
            if held and n + m > size:
                out.append("".join(x for x, _ in held))
                keep, back = 0, 0
                while keep < len(held) and back + held[-1 - keep][1] <= overlap:
                    back += held[-1 - keep][1]
                    keep += 1
                held = held[len(held) - keep :]
                n = back
            held.append((piece, m))
            n += m
        if held:
            out.append("".join(x for x, _ in held))
    return out


def effective_size(size: int, metadata_tokens: int, format_tokens: int = 0) -> int:
    """What metadata leaves of a chunk's tokens; a quarter of the chunk where it leaves nothing."""
    left = size - metadata_tokens - format_tokens
    return left if left > 0 else max(1, size // 4)


def split_with_metadata(docs: DataFrame, size: int = 1000, overlap: int = 200, id_col: str = "doc_id", text: str = "text", metadata: str = "metadata", split=None, format_tokens: int = 0) -> DataFrame:
    """Chunks that leave room for the document's metadata, as rows of id, chunk_index and chunk.

    metadata: the column with its text form. `split` is split_sentences unless
    given, or any function of text, size and overlap.
    """
    cut = split or split_sentences

    @F.pandas_udf("array<string>")
    def run(t: pd.Series, m: pd.Series) -> pd.Series:
        sizes = [effective_size(size, len((x or "").split()), format_tokens) for x in m]
        return pd.Series([cut(x, n, min(overlap, n)) for x, n in zip(t, sizes, strict=True)])

    return docs.select(id_col, F.posexplode(run(F.col(text), F.col(metadata).cast("string"))).alias("chunk_index", "chunk"))


#: Where a text is best cut, the best first; the cut is after the match.
_CUTS = [re.compile(p) for p in (r"[.!?](?=\s)", r"\n\n", r"\n", r"\s")]


def split_points(text: str | None, size: int) -> list[int]:
    """Places to cut a text into pieces of `size` characters, each up to a quarter longer where a sentence, paragraph, line or word ends there."""
    t, out, at = text or "", [], 0
    while at + size < len(t):
        low = at + size
        high = min(low + size // 4, len(t))
        found = (m.end() for p in _CUTS if (m := p.search(t, low, high + 1)) and m.start() < high)
        at = next(found, low)
        out.append(at)
    return out


def node_uuid(name: Column) -> Column:
    """The version 5 UUID of a name among object ids, by SHA-1 in the JVM."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8129dad11d180b400c04fd430c8")), name.cast("binary")))
    part = lambda i, n: F.substring(h, i, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def build_nodes(docs: DataFrame, split, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Nodes of every document by a Python splitter: id, chunk_index, node_id (stable), content, start, end, bytes, words, prev_id, next_id.

    Blank chunks are dropped, the others numbered without gaps; start and end
    are code points, see offsets().
    """

    def cut(t: str | None) -> list[dict]:
        chunks = [c for c in split(t) if c.strip()]
        return [{"content": c, "start": a, "end": z} for c, (a, z) in zip(chunks, offsets(t or "", chunks), strict=True)]

    rows = split_with(docs, cut, id_col, text, "array<struct<content: string, start: int, end: int>>").select(id_col, "chunk_index", "chunk.*")
    rows = rows.withColumn("node_id", node_uuid(F.concat_ws("-", F.col(id_col).cast("string"), F.col("chunk_index"))))
    rows = rows.withColumn("bytes", F.octet_length("content").cast("long")).withColumn("words", T.count_words(F.col("content")))
    w = Window.partitionBy(id_col).orderBy("chunk_index")
    return rows.withColumn("prev_id", F.lag("node_id").over(w)).withColumn("next_id", F.lead("node_id").over(w))


def offsets(text: str, chunks: list[str]) -> list[tuple[int, int]]:
    """Start and end of each chunk: its first occurrence after the last start, else right there."""
    out, at = [], 0
    for c in chunks:
        i = text.find(c.strip(), at)
        i = at if i < 0 else i
        out.append((i, min(len(text), i + len(c.strip()))))
        at = i + 1
    return out


def split_markdown(text: str | None, depth: int = 6, sep: str = "/", min_length: int = 0) -> list[dict]:
    """Sections with header, level and path of headers; # inside code fences is text."""
    out, stack, lines, fence = [], [], [], False

    def flush():
        body = "\n".join(lines).strip()
        if body and len(body) >= min_length:
            out.append({"path": sep + sep.join(h for _, h in stack) + (sep if stack else ""), "level": stack[-1][0] if stack else 0, "content": body})
        lines.clear()

    for line in (text or "").split("\n"):
        fence ^= line.lstrip().startswith("```")
        m = None if fence else re.match(r"^(#+)\s+(.*)$", line)
        if m and len(m[1]) <= depth:
            flush()
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            stack.append((len(m[1]), m[2].strip()))
        lines.append(line)
    flush()
    return out


class _Sections(HTMLParser):
    def __init__(self, tags):
        super().__init__()
        self.tags, self.open, self.out, self.skip = tags, [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag in self.tags:
            self.open.append([tag, []])

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                own = self.open.pop(i)
                self.out.append((tag, " ".join("".join(own[1]).split())))
                break

    def handle_data(self, data):
        if not self.skip:
            for _, parts in self.open:
                parts.append(data)


HTML_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "b", "i", "u", "section")


def split_html(html: str | None, tags=HTML_TAGS, min_bytes: int = 10) -> list[dict]:
    """Text of the elements with these tags, in the order in which they end."""
    p = _Sections(set(tags))
    p.feed(html or "")
    p.close()
    out = p.out + [(t, " ".join("".join(x).split())) for t, x in reversed(p.open)]
    return [{"tag": t, "content": s} for t, s in out if len(s.encode()) >= min_bytes]


def split_json(text: str | None, min_bytes: int = 10) -> list[str]:
    """A section for each object, outer ones first: its `key: value` lines and its path; arrays are summed up."""
    try:
        root = json.loads(text or "")
    except ValueError:
        return []
    out: list[str] = []

    def walk(x, path):
        if isinstance(x, dict):
            lines = [f"{k}: [Array with {len(v)} items]" if isinstance(v, list) else f"{k}: {json.dumps(v) if not isinstance(v, str) else v}" for k, v in sorted(x.items()) if not isinstance(v, dict)]
            if lines:
                out.append("\n".join(([f"Path: {'.'.join(path)}"] if path else []) + lines))
            for k, v in sorted(x.items()):
                walk(v, [*path, k])
        elif isinstance(x, list):
            for i, v in enumerate(x):
                walk(v, [*path, str(i)])
        elif not path:
            out.append(str(x))

    walk(root, [])
    return [x for x in out if len(x.encode()) >= min_bytes]


_DEF = re.compile(r"^(?:def |class |fn |pub |impl |struct |enum |function |export |public |private |async )")


def split_code(text: str | None, max_chars: int = 1500, lines: int = 40, overlap: int = 15) -> list[str]:
    """Chunks at top-level definitions, small neighbours joined up to max_chars; line windows for what is larger."""
    blocks, own = [], []
    for line in (text or "").split("\n"):
        if _DEF.match(line) and own:
            blocks.append("\n".join(own))
            own = []
        own.append(line)
    blocks.append("\n".join(own))
    out = []
    for b in blocks:
        if out and len(out[-1]) + 1 + len(b) <= max_chars:
            out[-1] += "\n" + b
        else:
            out.append(b)
    done = []
    for b in out:
        rows = b.split("\n")
        if len(b) <= max_chars:
            done.append(b)
        else:
            done += ["\n".join(rows[i : i + lines]) for i in range(0, len(rows), lines - overlap)]
    return [b for b in done if b.strip()]


def code_facts(text: str | None) -> dict:
    """Functions, classes, imports, comments and lines of code, by pattern."""
    t = text or ""
    return {
        "functions": re.findall(r"^\s*(?:pub )?(?:async )?(?:def|fn|function)\s+(\w+)", t, re.M),
        "classes": re.findall(r"^\s*(?:pub )?(?:class|struct|enum|interface|trait)\s+(\w+)", t, re.M),
        "imports": re.findall(r"^\s*(?:import|from|use|#include|require)\s+[\"<]?([\w.:/]+)", t, re.M),
        "comments": len(re.findall(r"^\s*(?:#|//|/\*)", t, re.M)),
        "loc": sum(bool(x.strip()) for x in t.split("\n")),
    }


#: Characters of texts and chunks that a worker holds before it sends chunks.
SENT = 1_000_000


def split_with(docs: DataFrame, split, id_col: str = "doc_id", text: str = "text", schema: str = "array<string>") -> DataFrame:
    """chunks of every document by a Python splitter, as rows of chunk_index and chunk.

    A worker sends its chunks whenever documents and chunks since the last time
    have SENT characters, and so never holds those of a whole Arrow batch.
    """
    kind = T_.StructType.fromDDL(f"x {schema}")[0].dataType.elementType
    src = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    out = T_.StructType([src.schema["id"], T_.StructField("chunk_index", T_.IntegerType()), T_.StructField("chunk", kind)])

    def run(batches):
        arrow = to_arrow_type(kind)

        def made(batch, own):
            at, nth, chunks = zip(*own, strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(nth, pa.int32()), pa.array(chunks, arrow)], names=["id", "chunk_index", "chunk"])

        for batch in batches:
            own, n = [], 0
            for i, t in enumerate(batch.column(1)):
                t = t.as_py()
                n += len(t or "")
                for j, c in enumerate(split(t)):
                    own.append((i, j, c))
                    n += sum(len(x) for x in (c.values() if isinstance(c, dict) else [c]) if isinstance(x, str))
                    if n >= SENT:
                        yield made(batch, own)
                        own, n = [], 0
            if own:
                yield made(batch, own)

    return src.mapInArrow(run, out).withColumnRenamed("id", id_col)


def hierarchical(docs: DataFrame, sizes=(2048, 512, 128), overlap: int = 20, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Nodes of every level: node_id, parent_id, doc_id, level, content. Children are split from their parents."""
    own = docs.select(F.col(id_col).cast("string").alias("up"), F.col(id_col), F.col(text).alias("body"))
    out = None
    for level, size in enumerate(sizes):
        rows = split_with(own, lambda t, s=size: split_sentences(t, s, min(overlap, s)), "up", "body").join(own.select("up", id_col), "up")
        rows = rows.select(F.concat_ws("/", "up", F.col("chunk_index")).alias("node_id"), F.when(F.lit(level > 0), F.col("up")).alias("parent_id"), id_col, F.lit(level).alias("level"), F.col("chunk").alias("content"))
        out = rows if out is None else out.union(rows)
        own = rows.select(F.col("node_id").alias("up"), id_col, F.col("content").alias("body"))
    return out
