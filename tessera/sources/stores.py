"""Stores as Parquet tables: vectors, key-values, documents, indexes, chat, graph, caches. A write makes a new version of its table."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Table:
    """A keyed table in a folder; each version is a subfolder, and the one with the largest number is read.

    A version is written under another name and renamed when it is complete, so
    a write that stops half-way leaves the last version as it was; a second
    writer that got the same number first makes the rename fail, and this
    write with it. That needs a file system that renames folders in one step,
    such as HDFS. The last KEEP versions stay, so readers of the one before
    aren't disturbed.
    """

    KEEP = 2

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str]):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def _fs(self, p: str):
        j = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        return j.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), j

    def versions(self) -> list[str]:
        """Complete versions, the oldest first."""
        fs, p = self._fs(self.path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.getPath().getName().startswith("v-")) if fs.exists(p) else []

    def read(self) -> DataFrame:
        own = self.versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{own[-1]}") if own else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame) -> None:
        own = self.versions()
        nth = int(own[-1][2:]) + 1 if own else 0
        part, name = f"{self.path}/_part-{uuid.uuid4().hex}", f"{self.path}/v-{nth:012d}"
        fs, src = self._fs(part)
        try:
            rows.select([F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], self.schema).schema]).write.parquet(part)
            dst = self._fs(name)[1]
            if fs.exists(dst) or not fs.rename(src, dst):
                raise RuntimeError(f"another write of {self.path} came first")
        finally:
            fs.delete(src, True)
        for old in [*own, f"v-{nth:012d}"][: -self.KEEP]:
            fs.delete(self._fs(f"{self.path}/{old}")[1], True)

    def upsert(self, rows: DataFrame) -> None:
        """New rows win; of several with one key, the one whose values as JSON are last in order."""
        last = Window.partitionBy(*self.key).orderBy(F.desc(F.to_json(F.struct(*rows.columns))))
        rows = rows.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_nth")
        old = self.read()
        self.replace(old.join(rows, self.key, "left_anti").unionByName(rows.select(old.columns)))

    def delete(self, keys: DataFrame) -> None:
        self.replace(self.read().join(keys, self.key, "left_anti"))

    def clear(self) -> None:
        self.replace(self.read().limit(0))

    def get(self, keys: DataFrame) -> DataFrame:
        """One row for each key, nulls where there is none; columns of keys (such as a position) stay."""
        return keys.join(self.read(), self.key, "left")

    def count(self) -> int:
        return self.read().count()


class VectorStore(Table):
    def __init__(self, spark, path, dims: int):
        super().__init__(spark, path, "node_id string, content string, embedding array<float>, metadata map<string,string>", ["node_id"])
        self.dims = dims

    def add(self, nodes: DataFrame) -> None:
        bad = nodes.filter(F.col("embedding").isNull() | (F.size("embedding") != self.dims))
        if not bad.isEmpty():
            raise ValueError(f"every node needs an embedding of {self.dims} numbers")
        self.upsert(nodes)

    def update(self, nodes: DataFrame) -> None:
        if not nodes.join(self.read(), "node_id", "left_anti").isEmpty():
            raise KeyError("an id is not in the store")
        self.add(nodes)


class KVStore(Table):
    def __init__(self, spark, path):
        super().__init__(spark, path, "collection string, key string, value string, created_at timestamp, updated_at timestamp", ["collection", "key"])

    def put(self, rows: DataFrame) -> None:
        """rows: collection, key, value. created_at of a known key stays; the last of several rows wins by value order."""
        old = self.read().select("collection", "key", F.col("created_at").alias("old"))
        w = Window.partitionBy("collection", "key").orderBy(F.desc("value"))
        one = rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
        now = F.current_timestamp()
        self.upsert(one.join(old, ["collection", "key"], "left").select("collection", "key", "value", F.coalesce("old", now).alias("created_at"), now.alias("updated_at")))

    def get_all(self, collection: str) -> DataFrame:
        return self.read().filter(F.col("collection") == collection)

    def collections(self) -> DataFrame:
        return self.read().groupBy("collection").agg(F.count("*").alias("n"))

    def delete_collection(self, collection: str) -> None:
        self.replace(self.read().filter(F.col("collection") != collection))


class DocumentStore(Table):
    def __init__(self, spark, path):
        super().__init__(spark, path, "doc_id string, content string, metadata map<string,string>, hash string", ["doc_id"])

    def add(self, docs: DataFrame) -> None:
        from tessera.functions.text import document_hash

        self.upsert(docs.withColumn("hash", document_hash(F.col("content"), F.col("metadata"))))

    def by_metadata(self, **want) -> DataFrame:
        out = self.read()
        for k, v in want.items():
            out = out.filter(F.col("metadata")[k] == v)
        return out


class ChatStore(Table):
    def __init__(self, spark, path):
        super().__init__(spark, path, "conv_id long, turn long, role string, text string", ["conv_id", "turn"])

    def messages(self, conv_id: int) -> DataFrame:
        return self.read().filter(F.col("conv_id") == conv_id).orderBy("turn")

    def append(self, rows: DataFrame) -> None:
        """rows: conv_id, nth, role, text; turns go on after the last one."""
        last = self.read().groupBy("conv_id").agg((F.max("turn") + 1).alias("next"))
        r = F.row_number().over(Window.partitionBy("conv_id").orderBy("nth")) - 1
        self.upsert(rows.withColumn("_r", r).join(last, "conv_id", "left").select("conv_id", (F.coalesce("next", F.lit(0)) + F.col("_r")).alias("turn"), "role", "text"))


class GraphStore:
    """Vertices and edges; edges need both ends."""

    def __init__(self, spark, path):
        self.vertices = Table(spark, f"{path}/vertices", "id string, name string, label string", ["id"])
        self.edges = Table(spark, f"{path}/edges", "source string, label string, target string", ["source", "label", "target"])

    def upsert(self, vertices: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        from tessera.operators.graph import valid_edges

        if vertices is not None:
            self.vertices.upsert(vertices)
        if edges is not None:
            self.edges.upsert(valid_edges(self.vertices.read(), edges))

    def delete(self, ids: DataFrame) -> None:
        """Vertices, and the edges that they end."""
        e = self.edges.read()
        gone = ids.select("id")
        e = e.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
        self.edges.replace(e)
        self.vertices.delete(gone)


class IndexStore(Table):
    """What an index is made of: index_id, kind, its nodes' ids and a summary."""

    def __init__(self, spark, path):
        super().__init__(spark, path, "index_id string, kind string, node_ids array<string>, summary string", ["index_id"])

    def add(self, index_id: str, kind: str, node_ids: list[str], summary: str | None = None) -> None:
        self.upsert(self.spark.createDataFrame([(index_id, kind, node_ids, summary)], self.schema))

    def struct(self, index_id: str):
        """The row of an index, or None."""
        return self.read().filter(F.col("index_id") == index_id).first()

    def drop(self, index_id: str) -> None:
        self.delete(self.spark.createDataFrame([(index_id,)], "index_id string"))


class CacheStore(Table):
    """Values by key that expire. Beyond `most` entries the oldest go (`oldest`), or the least used, of these the longest unused (`least_used`)."""

    def __init__(self, spark, path, most: int | None = None, evict: str = "oldest"):
        if evict not in ("oldest", "least_used"):
            raise ValueError("evict is oldest or least_used")
        super().__init__(spark, path, "key string, value string, created_at timestamp, expires_at timestamp, uses long, used_at timestamp", ["key"])
        self.most, self.evict, self.hits, self.misses, self.evictions = most, evict, 0, 0, 0

    def put(self, rows: DataFrame, ttl_seconds: int | None = None, now=None) -> None:
        """rows: key, value. Without ttl_seconds they never expire."""
        at = F.current_timestamp() if now is None else F.lit(now)
        end = F.lit(None).cast("timestamp") if ttl_seconds is None else at + F.make_dt_interval(secs=F.lit(ttl_seconds))
        self.upsert(rows.select("key", "value", at.alias("created_at"), end.alias("expires_at"), F.lit(0).cast("long").alias("uses"), at.alias("used_at")))
        self._shrink()

    def _shrink(self) -> None:
        if self.most is None:
            return
        n = self.count()
        if n > self.most:
            order = [F.desc("created_at"), "key"] if self.evict == "oldest" else [F.desc("uses"), F.desc("used_at"), "key"]
            self.evictions += n - self.most
            self.replace(self.read().orderBy(*order).limit(self.most))

    def lookup(self, keys: DataFrame, now=None) -> DataFrame:
        """key and value of the keys that are there and have not expired; uses are counted in the table, hits and misses here."""
        at = F.current_timestamp() if now is None else F.lit(now)
        live = F.col("expires_at").isNull() | (F.col("expires_at") > at)
        asked = keys.select("key").distinct()
        found = self.read().filter(live).join(asked, "key", "left_semi")
        n, m = asked.count(), found.count()
        self.hits, self.misses = self.hits + m, self.misses + n - m
        if m:
            rows = self.read().join(asked.withColumn("_asked", F.lit(True)), "key", "left")
            hit = F.coalesce("_asked", F.lit(False)) & live
            self.replace(rows.withColumn("uses", F.col("uses") + F.when(hit, 1).otherwise(0)).withColumn("used_at", F.when(hit, at).otherwise(F.col("used_at"))))
        return self.read().filter(live).join(asked, "key", "left_semi").select("key", "value")

    def cleanup(self, now=None) -> int:
        """Removes what has expired, and says how much."""
        at = F.current_timestamp() if now is None else F.lit(now)
        old, n = F.col("expires_at").isNotNull() & (F.col("expires_at") <= at), self.count()
        self.replace(self.read().filter(~old))
        return n - self.count()

    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"hits": self.hits, "misses": self.misses, "evictions": self.evictions, "hit_rate": self.hits / asked if asked else 0.0}


class StorageContext:
    """The stores of one project under one folder; persist() writes what they are, load() opens them again."""

    KINDS = {"documents": DocumentStore, "indexes": IndexStore, "chat": ChatStore, "kv": KVStore, "graph": GraphStore}

    def __init__(self, spark: SparkSession, path: str, dims: int | None = None):
        self.spark, self.path, self.dims = spark, path, dims
        for name, kind in self.KINDS.items():
            setattr(self, name, kind(spark, f"{path}/{name}"))
        self.vectors = VectorStore(spark, f"{path}/vectors", dims) if dims else None

    def persist(self) -> None:
        self.spark.createDataFrame([(json.dumps({"dims": self.dims, "stores": sorted(self.KINDS)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> StorageContext:
        return cls(spark, path, json.loads(spark.read.text(f"{path}/config").first()[0])["dims"])
