"""Token ids in files: frequency-ranked, byte-aligned variable-length codes.

A file is a table of segments. Each segment holds the ids of some documents:
a header with its ids in the order of their frequency there, the documents'
lengths, control bytes (two bits for each id: the number of its bytes less
one, four ids to a byte) and, apart from them, the data bytes of the ranks, so
most ids take one byte. Ranks are a segment's own, which saves a pass over the
corpus and costs the few kilobytes of its header. Decoding looks control bytes
up in numpy tables that give four lengths at once; there is no loop over ids.

Documents are dealt by ranges of doc_id and sorted, so file order is doc_id
order. Texts are encoded by the tokenizers library in pieces that its
pre-tokenizer never joins (cut at ASCII white space, and where an ASCII letter
or digit is followed by an ASCII sign); each different piece is encoded once
by a worker and kept in a table of bounded size, where it is found by a hash
and its bytes are compared. These cuts, and lower case for A-Z, are right for
vocabulary files that normalise and split as FITS says; texts for other files
go through the library whole.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import kept_in_worker, same_bytes, shared_dir, utf8, word_hashes

MAGIC = b"TSEG1\0\0\0"
#: Bytes of text in a segment, and pieces that a worker keeps.
SEGMENT_BYTES, KEPT_PIECES = 8 << 20, 1_500_000
END = 1
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_KIND = np.full(256, 3, np.uint8)  # 0: ASCII white space, 1: ASCII letter or digit, 2: other visible ASCII, 3: the rest
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[33:127] = 2
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _KIND[_a:_b] = 1


#: Steps of the normaliser and the pre-tokenizer that the cuts fit: NFC, white space to one space, lower case; words, digits and signs by a pattern that no white space is in, then bytes.
FITS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])


def _steps(tok) -> tuple[list[str], list[str]]:
    """The kinds of a tokenizer's normalising and splitting steps."""
    own = json.loads(tok.to_str())
    kinds = []
    for part, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")):
        step = own.get(part) or {}
        kinds.append([x["type"] for x in step.get(inner, [step] if step else [])])
    return tuple(kinds)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts; a table of bounded size keeps what each piece gave.

    The table is open addressing in numpy arrays, by a 64-bit hash of a piece.
    A piece that is found is compared byte for byte with the one that was
    learnt; where they differ, its texts go through the library whole.
    """

    def __init__(self, path: str, most: int = KEPT_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        self.cuts = _steps(self.tok) == FITS
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self):
        bits = max(12, (2 * self.most).bit_length())
        self.bits = np.uint64(64 - bits)
        self.keys, self.value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.off, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32)
        self.flat[0], self.off[1], self.n, self.used = END, 1, 1, 1  # piece 0 is the end of a document
        self.at, self.bytes = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint8)  # where a piece's bytes begin, and all bytes

    def learn(self, pieces: list[bytes], hashes: np.ndarray):
        got = self.tok.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)
        ids = [e.ids for e in got]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(n.sum()))
        while self.n + len(ids) + 1 > len(self.off):
            self.off = np.concatenate((self.off, np.zeros_like(self.off)))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        held = int(self.at[self.n])
        while self.n + len(ids) + 1 > len(self.at):
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
        while held + len(raw) > len(self.bytes):
            self.bytes = np.concatenate((self.bytes, np.zeros_like(self.bytes)))
        self.bytes[held : held + len(raw)] = raw
        self.at[self.n + 1 : self.n + 1 + len(ids)] = held + np.cumsum([*map(len, pieces)])
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(flat)] = flat
        self.off[self.n + 1 : self.n + 1 + len(ids)] = self.used + np.cumsum(n)
        values = np.arange(self.n, self.n + len(ids), dtype=np.int32)
        at, left = (hashes >> self.bits).astype(np.int64), np.arange(len(hashes))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = hashes[free]  # of those that want one place, the last has it
            self.value[at[free]] = values[free]
            left = left[self.keys[at[left]] != hashes[left]]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        self.n, self.used = self.n + len(ids), self.used + len(flat)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The pieces' numbers; -1 for those that aren't in the table."""
        at = (hashes >> self.bits).astype(np.int64)
        out, left = np.full(len(hashes), -1, np.int32), np.arange(len(hashes))
        while len(left):
            key = self.keys[at[left]]
            same = key == hashes[left]
            out[left[same]] = self.value[at[left[same]]]
            left = left[~same & (key != 0)]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        return out

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by END, and the number of ids of each."""
        raw = buf.tobytes()
        if not self.cuts:
            return self._each(raw, off)
        low = raw.translate(_LOWER)
        if any(x in raw or x.translate(_LOWER) in low for x in self.special):
            return self._each(raw, off)  # special tokens are spelt exactly and may not be cut
        buf = np.frombuffer(low, np.uint8)
        kind = np.zeros(len(buf) + 1, np.uint8)
        kind[:-1] = _KIND[buf]
        before = np.concatenate(([0], kind[:-2])) if len(buf) else kind[:0]
        before[off[:-1][off[:-1] < len(buf)]] = 0
        here = kind[:-1]
        starts = np.flatnonzero((here != 0) & (before == 0) | (here == 2) & (before == 1))
        after = kind[1:].copy()
        after[off[1:][off[1:] > 0] - 1] = 0
        ends = np.flatnonzero((here != 0) & (after == 0) | (here == 1) & (after == 2)) + 1
        hashes = np.maximum(word_hashes(buf, starts, ends), np.uint64(1))  # 0 is a free place
        if self.n > self.most:
            self.clear()
        at = self.find(hashes)
        lost = np.flatnonzero(at < 0)
        if len(lost):
            new, first = np.unique(hashes[lost], return_index=True)
            own = lost[first]
            for i in range(0, len(own), 1 << 16):
                if self.n + min(len(own) - i, 1 << 16) > 2 * self.most:
                    return self._each(low, off)
                k = own[i : i + (1 << 16)]
                self.learn([low[a:b] for a, b in zip(starts[k].tolist(), ends[k].tolist(), strict=True)], new[i : i + (1 << 16)])
            at[lost] = self.find(hashes[lost])
        n = ends - starts
        if (self.at[at + 1] - self.at[at] != n).any() or not same_bytes(buf, starts, self.bytes, self.at[at], n).all():
            return self._each(low, off)  # two pieces of one hash
        last = np.searchsorted(starts, off[1:])
        at = np.insert(at, last, 0)  # ends of documents
        size = (self.off[at + 1] - self.off[at]).astype(np.int32)
        upto = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        ids = self.flat[np.arange(upto[-1]) + np.repeat(self.off[at] - upto[:-1], size)]
        return ids.astype(np.uint32), np.diff(upto[np.concatenate(([0], last + np.arange(1, len(off))))])

    def _each(self, low: bytes, off: np.ndarray):
        """Without the table, for texts of more different pieces than it may hold."""
        own = [[*self.tok.encode(low[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids, END] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        return np.array([x for y in own for x in y], np.uint32), np.array([*map(len, own)], np.int64)


_LENGTHS = (np.arange(256)[:, None] >> (2 * np.arange(4)) & 3) + 1  # of the four ids of each control byte
_TOTALS = _LENGTHS.sum(1)
_BEFORE = np.cumsum(_LENGTHS, 1) - _LENGTHS  # where each of the four begins


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of pack()."""
    c = np.frombuffer(control, np.uint8)
    d = np.frombuffer(data + bytes(4), np.uint8)
    size = _LENGTHS[c].reshape(-1)[:n]
    group = np.cumsum(_TOTALS[c]) - _TOTALS[c]
    start = (group[:, None] + _BEFORE[c]).reshape(-1)[:n]
    out = d[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= d[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_segment(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One segment: header, ids by frequency, documents' lengths, control bytes, data bytes."""
    seen = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    ranked = np.argsort(-seen, kind="stable")[: np.count_nonzero(seen)].astype("<u4")
    rank = np.zeros(len(seen), np.uint32)
    rank[ranked] = np.arange(len(ranked))
    parts = [ranked.tobytes(), *pack(lengths), *pack(rank[ids] if len(ids) else ids)]
    return MAGIC + struct.pack("<7Q", len(lengths), len(ids), *map(len, parts)) + b"".join(parts)


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """ids and lengths of a segment."""
    if data[:8] != MAGIC:
        raise ValueError("not a segment")
    docs, n, *sizes = struct.unpack_from("<7Q", data, 8)
    at, parts = 8 + 56, []
    for s in sizes:
        parts.append(data[at : at + s])
        at += s
    ranked = np.frombuffer(parts[0], "<u4")
    ranks = unpack(parts[3], parts[4], n)
    return (ranked[ranks] if n else ranks), unpack(parts[1], parts[2], docs)


def _encode(path: str, most: int):
    def run(batches):
        enc = kept_in_worker(f"encoder {path}", lambda: Encoder(path))
        part, seq, held, size = 0, 0, [], 0

        def out():
            t = pa.concat_tables(held).combine_chunks()
            ids, lengths = [], []
            texts = t["text"]
            for i in range(0, len(t), 256):
                a, b = enc.encode(*utf8(texts.slice(i, 256)))
                ids.append(a)
                lengths.append(b)
            ids, lengths = np.concatenate(ids), np.concatenate(lengths)
            cols = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([t["doc_id"].to_pylist()], pa.list_(t.schema.field("doc_id").type)), pa.array([write_segment(ids, lengths)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "seq", "n_tokens", "doc_ids", "data"])

        for batch in batches:
            for i in range(0, len(batch), 256):
                piece = batch.slice(i, 256)
                part = piece.column(2)[0].as_py()
                held.append(pa.Table.from_batches([piece]))
                size += len(utf8(piece.column(1))[0])
                if size >= most:
                    yield out()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield out()

    return run


def write_tokens(docs: DataFrame, out: str, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write the ids of docs (doc_id, text) to the table `out`, in ascending doc_id order.

    Null texts are empty; each document ends with END. Null doc_ids stand
    first; equal doc_ids, and repeated rows, stand in the order of their texts.
    A very long text is a segment of its own. An empty table gives an empty
    one. The parts are numbered in the order of doc_id, segments within a part
    too. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = dealt.withColumn("part", F.spark_partition_id()).mapInArrow(_encode(path, segment_bytes), f"part int, seq int, n_tokens long, doc_ids array<{kind}>, data binary")
    rows.write.mode("overwrite").option("parquet.block.size", 64 << 20).parquet(out)


def _decode(batches):
    for batch in batches:
        for i in range(len(batch)):
            ids, lengths = read_segment(batch.column(3)[i].as_py())
            raw = memoryview(ids.astype("<u4").tobytes())
            ends = np.cumsum(lengths, dtype=np.int64)
            starts = ends - lengths
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(lengths)
            cols = [pa.array(np.full(n, batch.column(0)[i].as_py()), pa.int32()), pa.array(np.full(n, batch.column(1)[i].as_py()), pa.int32()), batch.column(2)[i].values, pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"])


def read_index(spark, out: str) -> DataFrame:
    """Per document of a table of segments: doc_id, start, n_tokens, ids_crc32, all from the stored ids."""
    files = spark.read.parquet(out)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    docs = files.select("part", "seq", "doc_ids", "data").select("part", "seq", "doc_ids", "data").mapInArrow(_decode, f"part int, seq int, doc_id {kind}, inner long, n_tokens long, ids_crc32 long")
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # as many rows as the write had partitions
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    segments = files.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("first"))
    bases = segments.join(parts, "part").select("part", "seq", (F.col("base") + F.col("first")).alias("base"))
    return docs.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op5(spark, sf_dir):
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, vocabulary())
    return read_index(spark, out)


def reference(docs: list[tuple], path: str) -> list[tuple]:
    """Plain encoding for tests: (doc_id, start, n_tokens, ids_crc32)."""
    from tokenizers import Tokenizer

    tok, at, out = Tokenizer.from_file(path), 0, []
    for d, text in sorted(docs, key=lambda x: x[0]):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, END]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out
