"""Loaders: files, code, web pages and CSV rows as documents (doc_id, content, metadata)."""

from __future__ import annotations

import fnmatch
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.media import mime_of

CODE = {"py": "python", "rs": "rust", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "shell", "sql": "sql", "html": "html", "css": "css", "lua": "lua", "r": "r", "jl": "julia", "hs": "haskell", "ex": "elixir", "clj": "clojure", "dart": "dart", "zig": "zig", "pl": "perl"}


def file_filter(include: list[str] = (), exclude: list[str] = (), ignore: list[str] = (), hidden: bool = False, min_size: int = 0, max_size: int | None = None, path: str = "path", size: str = "length") -> Column:
    """Globs on names; ignore takes lines of an ignore file; what include names is kept even if exclude names it."""
    name = F.element_at(F.split(F.col(path), "/"), -1)

    def any_of(globs, on):
        out = F.lit(False)
        for g in globs:
            out = out | F.regexp_like(on, F.lit(fnmatch.translate(g).replace("(?s:", "(?:").replace(r"\z", "$").replace(r"\Z", "$")))
        return out

    rules = [x.strip() for x in ignore if x.strip() and not x.startswith("#")]
    dropped = any_of([f"*/{r.rstrip('/')}/*" if r.endswith("/") else f"*/{r}" for r in rules if not r.startswith("!")], F.col(path)) & ~any_of([f"*/{r[1:]}" for r in rules if r.startswith("!")], F.col(path))
    keep = ~dropped & (F.col(size) >= min_size)
    if max_size is not None:
        keep = keep & (F.col(size) <= max_size)
    if not hidden:
        keep = keep & ~name.startswith(".")
    return keep & (any_of(include, name) if include else ~any_of(exclude, name))


def docx_text(data: bytes) -> str:
    """Paragraphs of a .docx, a line each."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


def pdf_text(data: bytes) -> str:
    """Text that simple PDFs show with Tj and TJ in plain or deflated streams."""
    import zlib

    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)endstream", data, re.S):
        body = m[1]
        try:
            body = zlib.decompress(body.rstrip(b"\r\n"))
        except zlib.error:
            pass
        for t in re.finditer(rb"\(((?:[^()\\]|\\.)*)\)\s*Tj|\[((?:[^\]\\]|\\.)*)\]\s*TJ", body, re.S):
            raw = t[1] if t[1] is not None else b"".join(re.findall(rb"\(((?:[^()\\]|\\.)*)\)", t[2]))
            out.append(re.sub(rb"\\([()\\])", rb"\1", raw).decode("latin-1"))
    return "\n".join(out)


def load_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True, where: Column | None = None, continue_on_error: bool = True) -> DataFrame:
    """Documents of a file or folder: text, PDF and DOCX. Unreadable ones are empty, or fail the job."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = (r.option("pathGlobFilter", glob) if glob else r).load(path)
    if where is not None:
        files = files.filter(where)

    @F.pandas_udf("string")
    def text(paths: pd.Series, data: pd.Series) -> pd.Series:
        def one(p, b):
            try:
                low = p.lower()
                if low.endswith(".docx"):
                    return docx_text(b)
                if low.endswith(".pdf"):
                    return pdf_text(b)
                if low.endswith(".doc"):
                    raise ValueError("legacy .doc isn't read")
                return b.decode("utf-8")
            except Exception:
                if continue_on_error:
                    return ""
                raise

        return pd.Series([one(p, b) for p, b in zip(paths, data, strict=True)])

    meta = F.create_map(F.lit("source"), F.col("path"), F.lit("filename"), F.element_at(F.split("path", "/"), -1), F.lit("directory"), F.regexp_replace("path", "/[^/]*$", ""), F.lit("content_type"), mime_of(F.col("path")), F.lit("file_size"), F.col("length").cast("string"), F.lit("modified"), F.unix_timestamp("modificationTime").cast("string"))
    return files.select(F.md5("path").alias("doc_id"), text("path", "content").alias("content"), meta.alias("metadata"))


def load_code(spark: SparkSession, path: str, **args) -> DataFrame:
    """Code files with their language and facts found by pattern."""
    from tessera.operators.splitters import code_facts

    @F.pandas_udf("functions array<string>, classes array<string>, imports array<string>, comments long, loc long")
    def facts(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([code_facts(x) for x in s], columns=["functions", "classes", "imports", "comments", "loc"])

    ext = F.lower(F.regexp_extract(F.col("metadata")["source"], r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in CODE.items() for x in kv])
    docs = load_files(spark, path, **args).withColumn("language", F.coalesce(F.try_element_at(table, ext), F.lit("unknown")))
    return docs.withColumn("facts", facts("content"))


class _Text(HTMLParser):
    def __init__(self, skip):
        super().__init__()
        self.skip_tags, self.depth, self.out = set(skip), 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.skip_tags

    def handle_endtag(self, tag):
        if tag in self.skip_tags:
            self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)


def html_text(html: str | None, skip=("script", "style", "nav", "footer", "header", "aside"), most: int = 1 << 20) -> str:
    p = _Text(skip)
    p.feed((html or "")[:most] if most else html or "")
    p.close()
    return "\n".join(x for x in (line.strip() for line in "".join(p.out).split("\n")) if x)


def load_pages(pages: DataFrame, url: str = "url", html: str = "html", id_col: str = "page_id", most: int = 0) -> DataFrame:
    """Fetched pages as documents; most > 0 reads at most so many characters of a page."""

    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        return s.map(lambda x: html_text(x, most=most))

    meta = F.create_map(F.lit("url"), F.col(url), F.lit("domain"), F.parse_url(url, F.lit("HOST")), F.lit("scheme"), F.parse_url(url, F.lit("PROTOCOL")))
    return pages.select(F.col(id_col).alias("doc_id"), text(html).alias("content"), meta.alias("metadata"))


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """Each CSV row as a document of JSON text."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.md5(F.to_json(F.struct("*"))).alias("doc_id"), F.to_json(F.struct("*")).alias("content"))
