"""A memory that is kept up to date under added and removed chunks, without being built anew.

The memory is three tables: what each chunk contributes to each node (parts), the nodes with their hubs and chains, and
the edges with their support. A change is a set of contributions that go and a set that come. Edges count, so their
support changes by sums of +1 and -1. Nodes also keep firsts and lasts, which sums cannot take back, so the nodes that a
change touches are put together again from what is left of their own contributions. Admission, hubs and chains depend on
the order of a video's nodes and are made anew for touched videos only; a video has a bounded number of admitted nodes.

The tables are cut in buckets by video. A change reads and writes the buckets of the videos it touches, into a new folder;
the others stay where they are. A Memory only names folders, so each state of it can still be read.

The order of observations is chunk, then place in the caption, as a number of its own: it does not shift when chunks come
or go, so a memory after any changes equals one that is built from the chunks that are left.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from . import memory as M

SCHEMAS = {
    "parts": "video long, chunk long, key string, seq long, node_type string, text string, n long, first_seen double, last_seen double, bucket int",
    "nodes": "video long, key string, node_id long, node_type string, text string, n long, n_chunks long, first_seen double, last_seen double, admitted boolean, hub long, next1 long, next2 long, bucket int",
    "edges": "video long, a string, b string, support long, bucket int",
}
NODE = [c.split()[0] for c in SCHEMAS["nodes"].split(", ")[:9]]
#: Places in a chunk's caption.
PLACES = 1 << 31
#: Tasks that write a bucket: with one, a memory of many videos is written by as few tasks as there are buckets.
SPREAD = 8


def ordered_log(captions: DataFrame) -> DataFrame:
    """The accepted observations of captions (video, chunk, ts, caption), with an order that other chunks don't change."""
    rows = M.accepted_items(captions)
    return rows.select("video", "chunk", "ts", (F.col("chunk").cast("long") * PLACES + F.col("item")).alias("seq"), "section", "node_type", "text")


def contributions(log: DataFrame) -> DataFrame:
    """What each chunk adds to each node."""
    firsts = [F.min_by(c, "seq").alias(c) for c in ("node_type", "text")]
    rows = M.keyed(log).groupBy("video", "chunk", "key").agg(F.min("seq").alias("seq"), *firsts, F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return rows.select(F.col("video").cast("long").alias("video"), F.col("chunk").cast("long").alias("chunk"), "key", "seq", "node_type", "text", "n", F.col("first_seen").cast("double").alias("first_seen"), F.col("last_seen").cast("double").alias("last_seen"))


def together(parts: DataFrame) -> DataFrame:
    """Nodes from their contributions."""
    text = F.min_by("text", "seq")
    rows = parts.groupBy("video", "key").agg(
        F.min("seq").alias("node_id"), F.min_by("node_type", "seq").alias("node_type"), text.alias("text"), F.sum("n").alias("n"), F.count("*").alias("n_chunks"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
    return rows.withColumn("text", F.when(F.col("key").startswith("id:"), X.id_text("text")).otherwise(F.col("text"))).select(*NODE)


def pairs(parts: DataFrame, sign: int) -> DataFrame:
    """Edges that contributions support, each chunk with sign."""
    seen = parts.filter("key like 'id:%' or node_type = 'entity'").select("video", "chunk", "key")
    return M.pair_counts(seen, ["video", "chunk"], ["video"]).withColumn("support", F.col("support") * sign)


def linked(nodes: DataFrame, cap: int) -> DataFrame:
    """Nodes with admission, hubs and chains."""
    place = F.row_number().over(Window.partitionBy("video").orderBy("node_id"))
    rows = M.hubs_by_id(nodes.select(*NODE, (place <= cap).alias("admitted")))
    acts = F.col("admitted") & (F.col("node_type") == "action") & F.col("hub").isNotNull()
    same = Window.partitionBy("video", acts, "hub").orderBy("node_id")
    rows = rows.withColumns({f"next{i}": F.when(acts, F.lead("node_id", i).over(same)) for i in (1, 2)})
    return rows.select(*NODE, "admitted", "hub", "next1", "next2")


@dataclass(frozen=True)
class Memory:
    """A state of the memory: where each bucket of each table lies."""

    spark: SparkSession
    folder: str
    buckets: int = 64
    cap: int = V.MAX_NODES
    places: dict[str, dict[int, str]] = field(default_factory=lambda: {t: {} for t in SCHEMAS})

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("video"), F.lit(self.buckets)).cast("int")

    def read(self, table: str, some: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        paths = [p for b, p in sorted(self.places[table].items()) if some is None or b in some]
        schema = SCHEMAS[table].rpartition(", ")[0]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def nodes(self) -> DataFrame:
        return self.read("nodes")

    def edges(self) -> DataFrame:
        return self.read("edges")

    def written(self, rows: DataFrame, version: str, table: str) -> dict[int, str]:
        base = f"{self.folder.rstrip('/')}/{version}/{table}"
        rows.withColumn("bucket", self.bucket()).repartition("bucket", F.pmod(F.xxhash64(F.lit(SPREAD), "video"), F.lit(SPREAD))).write.partitionBy("bucket").parquet(base)
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{base}/bucket=*")
        found = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(root) or []
        return {int(p.rpartition("=")[2]): p for p in (s.getPath().toString() for s in found)}

    def change(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> Memory:
        """The memory after captions (video, chunk, ts, caption) come and chunks (video, chunk) go; a chunk that comes again takes the place of the one before."""
        version = f"change-{uuid.uuid4().hex}"
        chunk = lambda df: df.select(F.col("video").cast("long").alias("video"), F.col("chunk").cast("long").alias("chunk"))
        gone_chunks = [chunk(df) for df in (added, removed) if df is not None]
        if not gone_chunks:
            return self
        folder = f"{self.folder.rstrip('/')}/{version}"
        gone_chunks[0].union(gone_chunks[-1]).distinct().write.parquet(f"{folder}/chunks")
        gone_chunks = self.spark.read.schema("video long, chunk long").parquet(f"{folder}/chunks")
        touched = sorted(r[0] for r in gone_chunks.select(self.bucket().alias("b")).distinct().collect())  # at most `buckets` numbers
        before = self.read("parts", touched)
        new = contributions(ordered_log(added)) if added is not None else before.limit(0)
        # What goes (-1), stays (0) and comes (1) is written once, since all that follows reads it.
        stage = f"{folder}/delta"
        marked = before.join(gone_chunks.withColumn("_gone", F.lit(-1)), ["video", "chunk"], "left").withColumn("sign", F.coalesce("_gone", F.lit(0))).drop("_gone")
        marked.unionByName(new.withColumn("sign", F.lit(1))).write.partitionBy("sign").parquet(stage)
        staged = self.spark.read.schema(SCHEMAS["parts"].replace("bucket int", "sign int")).parquet(stage)
        delta = staged.filter("sign <> 0")
        gone, new = delta.filter("sign < 0").drop("sign"), delta.filter("sign > 0").drop("sign")
        keys, videos = delta.select("video", "key").distinct(), delta.select("video").distinct()

        parts = staged.filter("sign >= 0").drop("sign")
        places = {"parts": self.written(parts, version, "parts")}
        after = replace(self, places={**self.places, "parts": self.moved("parts", touched, places["parts"])})
        parts = after.read("parts", touched)

        old = self.read("nodes", touched)
        own = old.join(videos, "video", "left_semi")
        fresh = own.select(*NODE).join(keys, ["video", "key"], "left_anti").unionByName(together(parts.join(keys, ["video", "key"], "left_semi")))
        nodes = old.join(videos, "video", "left_anti").unionByName(linked(fresh, self.cap))
        places["nodes"] = self.written(nodes, version, "nodes")

        change = pairs(gone, -1).union(pairs(new, 1)).groupBy("video", "a", "b").agg(F.sum("support").alias("support")).filter("support <> 0")
        edges = self.read("edges", touched).unionByName(change).groupBy("video", "a", "b").agg(F.sum("support").alias("support")).filter("support > 0")
        places["edges"] = self.written(edges, version, "edges")
        return replace(self, places={t: self.moved(t, touched, p) for t, p in places.items()})

    def moved(self, table: str, touched: list[int], found: dict[int, str]) -> dict[int, str]:
        return {b: p for b, p in self.places[table].items() if b not in touched} | found
