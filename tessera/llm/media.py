"""Media columns: interleaved document sequences.

parse_sequence() turns a page into one ordered list of items, each a text or a
reference to a media payload with its caption. Payloads live in a store that is
addressed by digest; resolve() joins references to it by digest, and since each
item carries its position, texts, media and captions stay aligned.

The store keeps payloads losslessly as PNG images of 8-bit RGB samples, 64
pixels (192 bytes) to a row, with the length before padding in a text chunk.
What is asked of a payload (features, digests) is computed where its stored
bytes are read, so only narrow rows meet the references; resolve() takes the
bytes themselves just as well. Catalyst drops an item's text where a query
doesn't ask for it, so texts don't travel to the store's rows.

Equal payloads have equal digests: the store's side of the join is one row for
each digest, made by partial sums, and is written before the join, so that
adaptive execution can split a digest to which a third of all documents refer
(it splits only what comes straight from two exchanges).
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, utf8

#: Bytes in a row of samples.
ROW = 192
_SIGN = b"\x89PNG\r\n\x1a\n"
_VOID = {"img", "br", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "param", "track"}
_SILENT = {"script", "style", "head", "title", "noscript", "template"}
_BLOCK = {"p", "div", "section", "article", "figure", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "blockquote", "pre", "main", "header", "footer", "nav", "aside", "body", "html", "br", "hr"}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(data: bytes) -> bytes:
    """Spaces appended up to a positive multiple of ROW bytes."""
    return data + b" " * ((-len(data)) % ROW or (0 if data else ROW))


def write_png(payload: bytes, length: int | None = None, level: int = 1) -> bytes:
    """A PNG of 8-bit RGB samples whose bytes are the payload (a positive multiple of ROW), and how many of them count."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    note = b"" if length is None else _chunk(b"tEXt", b"Length\0%d" % length)
    return _SIGN + _chunk(b"IHDR", head) + note + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> bytes:
    """The samples of an 8-bit RGB PNG without interlacing; every row filter is undone and every checksum compared."""
    if data[:8] != _SIGN:
        raise ValueError("not a PNG")
    at, body, head = 8, [], None
    while at < len(data):
        n = struct.unpack_from(">I", data, at)[0]
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if head is None or head[2:5] != (8, 2, 0) or head[6]:
        raise ValueError("only 8-bit RGB without interlacing is read")
    width = head[0] * 3
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(head[1], width + 1)
    kinds = lines[:, 0]
    if not kinds.any():
        return lines[:, 1:].tobytes()
    out = lines[:, 1:].astype(np.int32)
    for r in range(len(out)):
        x, up, kind = out[r], out[r - 1] if r else np.zeros(width, np.int32), kinds[r]
        if kind == 2:
            x[:] = x + up & 255
        elif kind in (1, 3, 4):
            for i in range(width):
                a = x[i - 3] if i >= 3 else 0
                b, c = up[i], up[i - 3] if i >= 3 else 0
                if kind == 4:
                    q = a + b - c
                    pa_, pb, pc = abs(q - a), abs(q - b), abs(q - c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                else:
                    guess = a if kind == 1 else (a + b) // 2
                x[i] = x[i] + guess & 255
    return out.astype(np.uint8).tobytes()


def read_length(data: bytes) -> int | None:
    """The length that write_png() has noted."""
    at = data.find(b"tEXtLength\0", 0, 64)
    return int(data[at + 11 : at + struct.unpack_from(">I", data, at - 4)[0] + 4]) if at > 0 else None


def features(payload: bytes) -> str:
    """Of the samples read back: size in pixels, mean and deviation of each channel, entropy, and a 64-bit average hash."""
    x = np.frombuffer(payload, np.uint8)
    rgb = x.reshape(-1, ROW // 3, 3)
    mean, dev = rgb.mean((0, 1)), rgb.std((0, 1))
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    cells = np.array_split(x.astype(np.float64), 64)  # 64 stretches of near equal length
    bright = np.array([c.mean() if len(c) else 0.0 for c in cells])
    bits = "".join("1" if b else "0" for b in bright > bright.mean())
    return json.dumps({"w": ROW // 3, "h": len(rgb), "mean": [round(float(v), 4) for v in mean], "std": [round(float(v), 4) for v in dev], "entropy": round(float(-(share * np.log2(share)).sum()), 4), "ahash": f"{int(bits, 2):016x}"}, separators=(",", ":"))


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.silent = 0
        self.figure: list[int] = []  # per open figure, the first item that is in it
        self.caption: list[str] | None = None

    def flush(self):
        said = " ".join("".join(self.text).split())
        if said:
            self.items.append({"text": said, "media": None, "caption": None})
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        if self.silent:
            return
        if tag in _BLOCK:
            self.flush()
        if tag == "figure":
            self.figure.append(len(self.items))
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "video", "audio", "source", "embed") and (src := dict(attrs).get("src")):
            self.flush()
            self.items.append({"text": None, "media": src.strip(), "caption": dict(attrs).get("alt") or None})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)
        elif tag in _SILENT:
            self.silent = max(0, self.silent - 1)

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
            return
        if self.silent:
            return
        if tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split()) or None
            self.caption = None
            for item in self.items[self.figure[-1] :] if self.figure else self.items[-1:]:
                if item["media"] is not None:
                    item["caption"] = said or item["caption"]
        elif tag in _BLOCK:
            self.flush()
        if tag == "figure" and self.figure:
            self.figure.pop()

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def parse_sequence(html: str | None) -> list[dict]:
    """Ordered items of a page: text, or media (the reference as written) with its caption.

    Captions come from figcaption, else from alt. A figcaption that stands
    before its picture is kept as text. Scripts, styles and heads are skipped;
    white space is collapsed; broken markup is read as far as it can be.
    """
    p = _Page()
    try:
        p.feed(html or "")
        p.close()
    except (AssertionError, ValueError):  # html.parser on some broken declarations
        pass
    if p.caption:
        p.text += p.caption
    p.flush()
    return p.items


_ITEM = pa.struct([("pos", pa.int32()), ("text", pa.string()), ("media", pa.string()), ("caption", pa.string())])
_ITEM_SQL = "array<struct<pos: int, text: string, media: string, caption: string>>"


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id and `items`, the ordered sequence of each page (pos, text, media, caption); null html gives no items."""

    def run(batches):
        for batch in batches:
            out = [[{"pos": k, **x} for k, x in enumerate(parse_sequence(h))] for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(_ITEM))], names=["id", "items"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(run, f"id {kind}, items {_ITEM_SQL}")


def resolve(items: DataFrame, store: DataFrame, columns: list[str]) -> DataFrame:
    """The items of all sequences (id, items), one row each, with what `store` (digest, columns) has of their references.

    Returns id, pos, text, media, caption and a struct `found`: null for texts
    and other references than `sha256:<digest>`, all null inside where the
    store lacks the digest. Positions and captions are untouched; a sequence
    without items gives no row, an empty table none. Store rows of one digest
    are the same payload: one of them is taken. Rows with one id are kept as
    they are, also if the id is null.
    """
    one = store.groupBy("digest").agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])
    one = cut(one.select("digest", F.struct(*columns).alias("of")))
    flat = items.select("id", F.explode("items").alias("item")).select("id", "item.pos", "item.text", "item.media", "item.caption")
    flat = flat.withColumn("digest", F.regexp_extract(F.coalesce("media", F.lit("")), "^sha256:([0-9a-f]{64})$", 1))
    got = flat.join(one, "digest", "left")
    lacks = F.struct(*[F.lit(None).cast(store.schema[c].dataType).alias(c) for c in columns])
    return got.select("id", "pos", "text", "media", "caption", F.when(F.col("digest") != "", F.coalesce("of", lacks)).alias("found"))


def interleaved(resolved: DataFrame) -> DataFrame:
    """resolve()'s rows gathered again: id and items (pos, text, media, caption, found) by position; one sequence has one id."""
    item = F.struct("pos", "text", "media", "caption", "found")
    return resolved.groupBy("id").agg(F.array_sort(F.collect_list(item), lambda a, b: a["pos"] - b["pos"]).alias("items"))


def _digest(text):
    """Names a payload by the text that it holds."""
    return F.sha2(text, 256)


def text_pages(docs: DataFrame) -> DataFrame:
    """doc_id and `html`: the text's lines as paragraphs and, after the first, the whole text as a figure.

    docs: doc_id, text; other columns are ignored. Null is an empty text. Signs
    that mean something in HTML are escaped, so any text is kept as it is, but
    for white space, which a page collapses.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    safe = F.regexp_replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), "\\n+", "</p><p>")
    figure = F.concat(F.lit('<figure><img src="sha256:'), _digest(text), F.lit('"><figcaption>The text above and below, as samples.</figcaption></figure>'))
    return docs.select("doc_id", _page(safe, figure).alias("html"))


def _page(safe, figure):
    """An article whose figure stands after the first paragraph."""
    first = F.substring_index(safe, "</p><p>", 1)
    rest = F.substr(safe, F.char_length(first) + 1)
    return F.concat(F.lit("<article><p>"), first, F.lit("</p>"), figure, F.lit("<p>"), F.regexp_replace(rest, "^</p><p>", ""), F.lit("</p></article>"))


def _store(batches):
    """The stored form of each text's payload."""
    for batch in batches:
        buf, off = utf8(batch.column(1))
        raw = buf.tobytes()
        for i in range(0, len(off) - 1, 512):
            own = range(i, min(i + 512, len(off) - 1))
            media = [write_png(pad(raw[off[k] : off[k + 1]]), int(off[k + 1] - off[k])) for k in own]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(own)), pa.array(media, pa.binary())], names=["digest", "media"])


_READ = pa.schema([("digest", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
FOUND = _READ.names[1:]


def _read(batches):
    """What the stored bytes hold, read back: one narrow row for each medium."""
    for batch in batches:
        rows = []
        for digest, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p = read_png(media)
            rows.append({"digest": digest, "n_bytes": read_length(media), "payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-16:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": features(p)})
        yield pa.RecordBatch.from_pylist(rows, _READ)


def text_store(docs: DataFrame) -> DataFrame:
    """digest and media: the payload of every text, written to the shared folder in its stored form.

    docs: text; other columns are ignored. A payload is the UTF-8 text (null:
    empty) with spaces up to a positive multiple of ROW bytes. Repeated rows
    are stored one by one; a very long text is one medium. An empty table
    gives an empty store.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return cut(docs.select(_digest(text).alias("digest"), text.alias("text")).mapInArrow(_store, "digest string, media binary"))


def read_store(store: DataFrame) -> DataFrame:
    """digest and FOUND of every stored medium, from its bytes."""
    return store.select("digest", "media").mapInArrow(_read, "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id and FOUND of every document, by way of its page's sequence and the store.

    docs: doc_id, text; other columns are ignored. Null and empty texts have a
    payload of one row of spaces. Equal texts have equal values; repeated rows
    and null doc_ids have a row each. An empty table gives an empty table.
    """
    items = resolve(sequences(text_pages(docs), "doc_id"), read_store(text_store(docs)), FOUND)
    return items.filter("media is not null").select(F.col("id").alias("doc_id"), "found.*")


def op4(spark, sf_dir):
    return text_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
