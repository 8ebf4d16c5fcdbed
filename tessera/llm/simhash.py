"""SimHash near-duplicates by covering locality-sensitive hashing.

Every text gets a 64-bit fingerprint. To find all pairs within r bits, each
bit position is given a nonzero vector of r+1 bits; for each of the 2**(r+1)-1
nonzero vectors v, a table keeps the positions whose vector has an odd inner
product with v. The vectors of any r positions miss some dimension, so some v
is orthogonal to all of them: its table ignores exactly those positions, and
any two fingerprints that differ only there share its bucket. No pair within
the radius is lost, whatever the data.

Only distinct fingerprints are compared. Buckets of two are settled by a XOR
in the aggregate itself; larger ones by popcounts in numpy, one member against
all that aren't reached yet, of which the links of a spanning forest leave the
task, never all pairs. A bucket of more than CAP members is hashed again by the
same construction on the bits its table ignored; a table ignores about half of
them, so after DEPTH times about two bits are left, and few fingerprints.
Components are found by alternating
large-star and small-star rounds, all in DataFrames.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, free_name, mix, release, slices, span_hashes, utf8, word_hashes, words

#: Members of a bucket that are compared directly, and times that a larger one is hashed again.
CAP, DEPTH = 4096, 4
#: Nodes of a large part of all links that are sent to every task, at most.
HUBS = 4096
#: Rows of a node that one task may well take.
HUB_ROWS = 100_000
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over the positions such that any `radius` of them are absent from some mask."""
    n = (1 << (radius + 1)) - 1
    vector = {p: k % n + 1 for k, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(shingle: int, seeds: tuple[int, ...]):
    def run(batches):
        for batch in batches:
            buf, off = utf8(batch.column(1))
            low = buf.tobytes().translate(_LOWER)
            out = np.zeros((len(seeds), len(off) - 1), np.uint64)
            for i, j in slices(off, 1 << 20):
                text = b"\n".join(b" ".join(low[off[k] : off[k + 1]].split()) for k in range(i, j)) + b"\n"
                raw = np.frombuffer(text, np.uint8)
                ends_of = np.flatnonzero(raw == 10) + 1
                starts, ends, first = words(raw, np.concatenate(([0], ends_of)))
                n = np.diff(first)  # words of each document
                has = np.flatnonzero(n)
                if not len(has):
                    continue
                last = np.repeat(first[1:][has], np.maximum(1, n[has] - shingle + 1))  # one past the document's last word
                m = np.maximum(1, n[has] - shingle + 1)
                begin = np.concatenate(([0], np.cumsum(m)))
                w = np.arange(begin[-1]) - np.repeat(begin[:-1], m) + np.repeat(first[:-1][has], m)
                a, b = starts[w].tolist(), ends[np.minimum(w + shingle, last) - 1].tolist()
                pieces = [text[x:y] for x, y in zip(a, b, strict=True)]
                for row, seed in enumerate(seeds):
                    one = xxhash.xxh64_intdigest
                    h = np.fromiter((one(p, seed) for p in pieces), np.uint64, len(pieces))
                    out[row, i + has] = _vote(h, begin)
            cols = [batch.column(0)] + [pa.array(x.view(np.int64)) for x in out]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "fp", "chk"][: len(cols)])

    return run


def _vote(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each group of hashes, the bits that are set in over half of them."""
    n = len(begin) - 1
    out = np.zeros(n, np.uint64)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + 65536, "right")) - 1)
        bits = np.unpackbits(h[begin[i] : begin[j]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, begin[i:j] - begin[i], axis=0, dtype=np.int32)
        most = counts * 2 > np.diff(begin[i : j + 1])[:, None]
        out[i:j] = np.packbits(most, axis=1, bitorder="little").view(np.uint64)[:, 0]
        i = j
    return out


def fingerprints(docs: DataFrame, shingle: int = 5, check: bool = False) -> DataFrame:
    """doc_id, fp and, if asked for, a second fingerprint chk by another seed.

    A-Z are lower-cased; words are split at ASCII white space; shingles are
    `shingle` words joined by one space, repeats included; fewer words are one
    shingle; none (also null): fingerprint 0. A bit is set if it is in over
    half of the shingles' XXH64.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(shingle, (42, 1042) if check else (42,)), f"doc_id {kind}, fp long" + ", chk long" * check)


def _forest(radius: int, far: int):
    """Links of a spanning forest of each bucket: a, b (nodes). Each member is compared once with all that aren't reached yet."""

    def run(batches):
        for batch in batches:
            nodes, fps, chks = (batch.column(i) for i in range(3))
            a, b = [], []
            off = nodes.offsets.to_numpy() if len(batch) else np.zeros(1, np.int32)
            flat = [x.values.to_numpy(zero_copy_only=False) for x in (nodes, fps, chks)]
            for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                node, fp, chk = flat[0][x:y], flat[1][x:y].view(np.uint64), flat[2][x:y].view(np.uint64)
                left, reached = np.arange(y - x), []
                while reached or len(left):
                    if not reached:
                        reached, left = [int(left[0])], left[1:]
                    k = reached.pop()
                    near = np.bitwise_count(fp[left] ^ fp[k]) <= radius
                    if far < 64:
                        near &= np.bitwise_count(chk[left] ^ chk[k]) <= far
                    own = left[near]
                    if len(own):
                        a.append(node[own])
                        b.append(np.full(len(own), node[k]))
                        reached += own.tolist()
                        left = left[~near]
            cols = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (a, b)]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b"])

    return run


def near_links(prints: DataFrame, radius: int = 3, far: int = 64, cap: int = CAP) -> DataFrame:
    """Links a, b among distinct prints (node, fp, chk) that connect whatever lies within the radius, in chains also.

    chk must agree but for `far` bits too. Enough links for the components,
    each between two prints of one component. In a row, `left` has the bits
    that the tables which led here ignored, `home` names the bucket that was
    overfull (0 at first).
    """
    rows, links = prints.withColumns({"left": F.lit(-1).cast("long"), "home": F.lit(0).cast("long")}), None
    for depth in range(DEPTH + 1):
        last = depth == DEPTH
        masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(_turned(depth), radius)])
        here = rows.withColumn("mask", F.explode(masks)).withColumn("key", F.col("fp").bitwiseAND(F.col("mask").bitwiseAND(F.col("left"))))
        on = ["home", "mask", "key"]
        sums = here.groupBy(*on).agg(F.count("*").alias("n"), F.bit_xor("fp").alias("x"), F.bit_xor("chk").alias("y"), F.min("node").alias("a"), F.max("node").alias("b")).filter("n > 1")
        sums = cut(sums)
        two = sums.filter((F.col("n") == 2) & (F.bit_count("x") <= radius) & (F.bit_count("y") <= far)).select("a", "b")
        some = sums.filter("n > 2" if last else f"n > 2 and n <= {cap}").select(*on)
        groups = here.join(some, on).groupBy(*on).agg(F.collect_list("node").alias("nodes"), F.collect_list("fp").alias("fps"), F.collect_list("chk").alias("chks"))
        found = two.union(groups.select("nodes", "fps", "chks").mapInArrow(_forest(radius, far), "a long, b long"))
        links = found if links is None else links.union(found)
        hot = sums.filter(F.col("n") > cap).select(*on)
        if last or hot.isEmpty():
            return cut(links.distinct())
        # The overfull buckets, hashed again on the bits that their table ignores.
        left = F.col("left").bitwiseAND(F.bitwise_not("mask"))
        rows = cut(here.join(hot, on).select("node", "fp", "chk", left.alias("left"), F.xxhash64(*on).alias("home")))


def _turned(depth: int) -> list[int]:
    """All bit positions, in another order at each depth, so that tables of different depths ignore different halves."""
    step = (1, 23, 11, 37, 29, 51)[depth % 6]
    return [(p * step + depth) % 64 for p in range(64)]


def components(links: DataFrame) -> DataFrame:
    """v, root for every end of a link; root is the smallest node of v's component.

    Alternating large-star and small-star rounds until nothing changes; each
    round is written to the shared folder.
    """

    def star(pairs: DataFrame, rows: int) -> DataFrame:
        """u, v and m, the least of u and its neighbours. A node with over 1/HUBS of all rows (there are fewer than HUBS) meets its rows where they are."""
        if rows <= HUB_ROWS:  # no node can have more, so one task may take all of a node's
            return pairs.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
        least = cut(pairs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count("*").alias("k")))
        hubs = F.broadcast(least.filter(F.col("k") > max(rows / HUBS, HUB_ROWS)).select("u", "m"))  # fewer than HUBS rows
        return pairs.join(hubs.select("u"), "u", "left_anti").join(least.drop("k"), "u").union(pairs.join(hubs, "u"))

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    was = state(e)
    while was[0]:
        both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        large = star(both, 2 * was[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if was[0] > HUB_ROWS:  # in a small round, rows that are there twice change nothing
            large = cut(large.distinct())
        small = star(large, was[0])
        small = small.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        e = cut(small.filter("u <> v").distinct())
        now = state(e)
        if now == was:
            break
        was = now
        release(e)
    return e.select(F.col("u").alias("x"), "v").groupBy("x").agg(F.min("v").alias("root")).select(F.col("x").alias("v"), "root").union(e.select("v", F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 3, check: int | None = None, cap: int = CAP) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, for every document.

    docs: doc_id, text; other columns are ignored. Documents are linked if
    their fingerprints differ in at most `radius` bits (and, if `check` is
    given, second fingerprints by another seed in at most `check` bits, which
    keeps chance links out of very large collections). component_id is the
    smallest doc_id of all that links reach. Null, empty and wordless texts
    all have fingerprint 0 and link like any other. Null doc_ids are never a
    component_id unless all of a component are null. Repeated rows each give
    a row. Very long texts are read whole. An empty table gives an empty table.
    """
    all_prints = fingerprints(docs, shingle, check is not None)
    if check is None:
        all_prints = all_prints.withColumn("chk", F.lit(0).cast("long")).withColumn("node", F.col("fp"))
    else:
        all_prints = all_prints.withColumn("node", F.xxhash64("fp", "chk"))
    all_prints = cut(all_prints)
    prints = cut(all_prints.groupBy("node", "fp", "chk").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(prints.drop("least"), radius, 64 if check is None else check, cap))
    linked = prints.join(roots, prints["node"] == roots["v"]).select("node", "root", "least")
    own = linked.join(linked.groupBy("root").agg(F.min("least").alias("component")), "root").select("node", "component")
    # Written before the join, so that adaptive execution can split a print that many documents have.
    of = cut(prints.join(own, "node", "left").select("node", F.coalesce("component", "least").alias("component_id")))
    out = all_prints.join(of, "node")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: keep_one: 64-bit fingerprints of a document.
PRINTS = 4
#: Of a pair of exactly Jaccard 0.8, the odds that one bit agrees: 1 - acos(2 * 0.8 / 1.8) / pi.
AGREE = 0.8485
#: Of the first 128 bits, how many may differ in a pair that is worth comparing; at Jaccard 0.8 it is 19, standard deviation 4.
FAR = 40
#: Documents are near-duplicates if common shingles are at least 4/5 of all that either has.
NEAR = (4, 5)


def _shingle_sets(buf: np.ndarray, off: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each document's shingles, and each document's first (n+1)."""
    low = np.frombuffer(buf.tobytes().translate(_LOWER), np.uint8)
    starts, ends, first = words(low, off)
    n = np.diff(first)
    m = np.where(n > 0, np.maximum(1, n - shingle + 1), 0)
    begin = np.concatenate(([0], np.cumsum(m)))
    w = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], m)
    h = span_hashes(word_hashes(low, starts, ends), w, np.minimum(w + shingle, np.repeat(first[1:], m)), 0x9FB21C651E98DF25)
    doc = np.repeat(np.arange(len(n)), m)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=len(n)))))


def _set_name(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name each set of hashes."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(salt)))))
        out.append((sums[begin[1:]] - sums[begin[:-1]]).view(np.int64))
    return out[0], out[1]


def table_shape(n: int) -> tuple[int, int]:
    """Bits of a table's key and tables, for n sets: some eight sets to a key, and as many tables as a pair of 0.8 needs.

    A table holds such a pair with odds of AGREE**bits; with 5.5 over that, all
    miss it with odds of 0.4 %. So tables grow as about n**0.24.
    """
    bits = min(36, max(12, n.bit_length() - 3))
    return bits, int(np.ceil(5.5 / AGREE**bits))


def _set_prints(shingle: int):
    """doc_id, h (a hash of its text), the name of its set of shingles (s, t) and fingerprints of the set by independent seeds."""

    def run(batches):
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for i, j in slices(off, 1 << 19):
                h, begin = _shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], shingle)
                out = np.zeros((PRINTS, j - i), np.uint64)
                has = np.flatnonzero(np.diff(begin))
                if len(has):
                    for k in range(PRINTS):
                        out[k, has] = _vote(mix(h * np.uint64(2) + np.uint64(0xD6E8FEB86659FD93 + 2 * k)), np.append(begin[has], begin[-1]))
                cols = [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), *map(pa.array, _set_name(h, begin)), *[pa.array(x.view(np.int64)) for x in out]]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "s", "t", *[f"f{k}" for k in range(PRINTS)]])

    return run


def _sets(shingle: int):
    """The name of each document's set (s, t) and the set itself."""

    def run(batches):
        for batch in batches:
            buf, off = utf8(batch.column(0))
            for i, j in slices(off, 1 << 19):
                h, begin = _shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], shingle)
                own = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*map(pa.array, _set_name(h, begin)), own], names=["s", "t", "own"])

    return run


def _table_keys(bits: int, tables: int):
    """A row for each node and table: key, node, comp, f0, f1."""

    def run(batches):
        r = np.random.default_rng(64)
        at = [r.choice(64 * PRINTS, bits, replace=False) for _ in range(tables)]
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                node, comp, *prints = (c.to_numpy(zero_copy_only=False) for c in part.columns)
                own = np.unpackbits(np.stack(prints, 1).view(np.uint8), axis=1, bitorder="little").astype(np.int64)
                key = np.concatenate([own[:, x] @ (1 << np.arange(bits)) + (k << bits) for k, x in enumerate(at)])
                yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(np.tile(x, tables)) for x in (node, comp, *prints[:2])]], names=["key", "node", "comp", "f0", "f1"])

    return run


def _by_key(settle):
    """Feeds rows sorted by their first column to settle, all rows of a key at once."""

    def run(batches):
        held: list = []  # of a key whose rows may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            key = batch.column(0).to_numpy()
            if held and held[-1].column(0)[-1].as_py() == key[0] == key[-1]:
                held.append(batch)
                continue
            last = int(np.searchsorted(key, key[-1]))
            if last or (held and held[-1].column(0)[-1].as_py() != key[-1]):
                yield from settle(pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks())
                held = []
            held.append(batch.slice(last))
        if held:
            yield from settle(pa.Table.from_batches(held).combine_chunks())

    return run


def _runs(x: np.ndarray, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first row of its run of equal values, and the first after it."""
    new = x[1:] != x[:-1]
    if y is not None:
        new |= y[1:] != y[:-1]
    head = np.flatnonzero(np.concatenate(([True], new)))
    n = np.diff(np.append(head, len(x)))
    return np.repeat(head, n), np.repeat(np.append(head[1:], len(x)), n)


def _apart(f: np.ndarray, g: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(f[i] ^ f[j]).astype(np.int16) + np.bitwise_count(g[i] ^ g[j])


def _columns(t: pa.Table, names: list[str]):
    return [t[c].to_numpy() if c not in ("f0", "f1") else t[c].to_numpy().view(np.uint64) for c in names]


def _first_pairs(t: pa.Table):
    """For each row that has a near one under its key, one of them: node, other, apart (bits). The closest before it, else the closest after."""
    key, node, f, g = _columns(t, ["key", "node", "f0", "f1"])
    low, high = _runs(key)
    alone = np.arange(len(key))
    for back in (True, False):
        left, lonely, d = alone, [], 0
        while len(left):
            d += 1
            ok = left - d >= low[left] if back else left + d < high[left]
            lonely.append(left[~ok])
            left = left[ok]
            other = left - d if back else left + d
            apart = _apart(f, g, left, other)
            near = apart <= FAR
            if near.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[left[near]]), pa.array(node[other[near]]), pa.array(apart[near].astype(np.int32))], names=["node", "other", "apart"])
            left = left[~near]
        alone = np.concatenate(lonely) if lonely else alone


def _open_rows(t: pa.Table):
    """Of rows sorted by key and comp, those that are near a row of their key and another component: key, node, comp."""
    key, node, comp, f, g = _columns(t, ["key", "node", "comp", "f0", "f1"])
    _, high = _runs(key)
    _, after = _runs(key, comp)
    opened = np.zeros(len(key), bool)
    left, d = np.flatnonzero(after < high), 0
    while len(left):
        other = after[left] + d
        ok = other < high[left]
        left, other = left[ok], other[ok]
        near = _apart(f, g, left, other) <= FAR
        opened[left[near]] = opened[other[near]] = True
        d += 1
    own = np.flatnonzero(opened)
    yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (key, node, comp)], names=["key", "node", "comp"])


def _set_links(t: pa.Table):
    """Of rows with their sets, links a, b between components of one key whose sets are similar: a forest of the components."""
    key, node, comp = _columns(t, ["key", "node", "comp"])
    sets = t["own"].chunk(0)
    off, flat = sets.offsets.to_numpy().astype(np.int64), sets.values.to_numpy()
    a, b = [], []
    low, _ = _runs(key)
    for x in np.unique(low).tolist():
        y = int(np.searchsorted(low, x, "right"))
        n = np.diff(off[x : y + 1])
        own = np.flatnonzero(n) + x  # an empty set is like no other
        if len(own) < 2:
            continue
        n = n[own - x]
        begin = np.cumsum(n) - n
        _, at = np.unique(flat[off[x] : off[y]], return_inverse=True)
        here = np.zeros(int(at.max()) + 1, bool)
        _, top = np.unique(comp[own], return_inverse=True)
        for i in range(len(own) - 1):
            if (top == top[i]).all():
                break
            mine = at[begin[i] : begin[i] + n[i]]
            here[mine] = True
            both = np.add.reduceat(here[at[begin[i + 1] :]], begin[i + 1 :] - begin[i + 1], dtype=np.int64)
            here[mine] = False
            like = np.flatnonzero((both * NEAR[1] >= (n[i] + n[i + 1 :] - both) * NEAR[0]) & (top[i + 1 :] != top[i])) + i + 1
            for j in like.tolist():
                if top[j] != top[i]:
                    a.append(min(node[own[i]], node[own[j]]))
                    b.append(max(node[own[i]], node[own[j]]))
                    top[top == top[j]] = top[i]
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def jaccard_nodes(docs: DataFrame, shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, least: doc_id and text hash h of the smallest document), one for each different set of shingles, and v, root of the nodes that are linked.

    Candidates share a key in one of the tables and are near in 128 bits;
    linked are those whose sets have a Jaccard similarity of 4/5 by all their
    shingles. First each node meets the nearest of its candidates, as a pair.
    Then the nodes that still have candidates in other components meet them
    under their keys, with 31 bits of each shingle: all of these are compared
    there, and only a forest of links leaves the task, so a large group of
    texts that are near, but not near enough, never becomes a table of pairs.
    These links are compared once more by all 64 bits.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = [f"f{k}" for k in range(PRINTS)]
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    named = docs.mapInArrow(_set_prints(shingle), f"doc_id {kind}, h long, s long, t long, " + ", ".join(f"{c} long" for c in prints))
    nodes = cut(named.groupBy("s", "t", *prints).agg(F.min(F.struct("doc_id", "h")).alias("least")).withColumn("node", F.xxhash64("s", "t")))
    shape = table_shape(nodes.count())

    def dealt(comp: DataFrame) -> DataFrame:
        keys = comp.select("node", "comp", *prints).mapInArrow(_table_keys(*shape), "key long, node long, comp long, f0 long, f1 long")
        return keys.repartition("key").sortWithinPartitions("key", "comp", "node")

    first = dealt(nodes.withColumn("comp", F.col("node"))).mapInArrow(_by_key(_first_pairs), "node long, other long, apart int")
    first = cut(first.groupBy("node").agg(F.min(F.struct("apart", "other")).alias("x")).select("node", "x.other"))
    # Every node that has a candidate at all is here, so these are all sets that will be asked for.
    own = docs.join(nodes.join(first, "node").select("least.doc_id", "least.h"), ["doc_id", "h"], "left_semi")
    sets = own.select("text").mapInArrow(_sets(shingle), "s long, t long, own array<long>").select(F.xxhash64("s", "t").alias("node"), "own")
    sets = cut(sets.dropDuplicates(["node"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a")
        both = with_a.join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b").withColumn("both", F.size(F.array_intersect("x", "y")))
        return cut(both.filter(F.col("both") * NEAR[1] >= (F.size("x") + F.size("y") - F.col("both")) * NEAR[0]).select("a", "b"))

    links = confirmed(first.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())
    of = nodes.join(components(links), F.col("node") == F.col("v"), "left").withColumn("comp", F.coalesce("root", "node"))
    opened = cut(dealt(of).mapInArrow(_by_key(_open_rows), "key long, node long, comp long"))
    short = sets.select("node", F.transform("own", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("own"))
    met = opened.join(short, "node").select("key", "node", "comp", "own").repartition("key").sortWithinPartitions("key", "comp", "node")
    rest = confirmed(met.mapInArrow(_by_key(_set_links), "a long, b long").distinct())
    return nodes, components(links.union(rest))


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs with all their columns, of each group of near-duplicates the one with the smallest doc_id.

    Near-duplicates have a Jaccard similarity of at least 0.8 between their
    sets of five-word shingles (words as in fingerprints()), or are linked by
    others that have. Null, empty and wordless texts have no shingles: they
    are one group. Candidates come from SimHash tables, see jaccard_nodes().
    Two texts that share a doc_id are two documents; of rows with the same
    doc_id and text one stays, whatever their other columns. Rows with a null
    doc_id take no part and stay. Very long texts are compared whole. An empty
    table gives an empty table.
    """
    named = docs.filter(F.col("doc_id").isNotNull())
    nodes, roots = jaccard_nodes(named, shingle)
    stay = nodes.join(roots, F.col("node") == F.col("v"), "left").groupBy(F.coalesce("root", "node")).agg(F.min("least").alias("least"))
    h = free_name(docs, "h")
    stay = stay.select(F.col("least.doc_id").alias("doc_id"), F.col("least.h").alias(h))
    kept = named.withColumn(h, F.xxhash64("text")).join(stay, ["doc_id", h], "left_semi").dropDuplicates(["doc_id", h])
    return kept.select(*docs.columns).union(docs.filter(F.col("doc_id").isNull()))


def op2(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, radius=3)


def reference(docs: list[tuple], shingle: int = 3, radius: int = 3) -> list[tuple]:
    """Brute force for tests: (doc_id, fingerprint, component_id)."""
    prints = []
    for _, text in docs:
        w = (text or "").encode().translate(_LOWER).split()
        own = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in own]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    top = [*range(len(docs))]

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    fps = np.array(prints, np.uint64)
    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius).tolist():
            a, b = find(i), find(i + 1 + j)
            top[a] = b
    least: dict = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{prints[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(docs)]
