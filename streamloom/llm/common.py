"""Shared helpers: tables in the shared folder, and byte, word and window hashing over Arrow text columns."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U = np.uint64
#: Rows in an Arrow batch of a materialised step.
BATCH_ROWS = 500
#: ASCII white space, as in [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)


#: The temporary folder of each local application that names none.
_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); in local mode, where all is one machine, a temporary one if none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIR:
            _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="shared-")
        found = _OWN_DIR[app]
    return found.rstrip("/")


#: Folders that materialise has written in this process and that are not released.
_WRITTEN: list[str] = []


def written() -> list[str]:
    return list(_WRITTEN)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate folders that nothing reads any more."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if p in _WRITTEN:
            _WRITTEN.remove(p)


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    What was shuffled for it is not needed again once it is written, so Spark removes that at the end of the write.
    Rows may hold packed arrays, so few of them go to Python in a batch.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    during = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}
    before = {k: spark.conf.get(k, None) for k in during}
    for k, v in during.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
        _WRITTEN.append(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def struct_of(df: DataFrame, *names: str) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Powers:
    """Powers of an odd base mod 2^64 and of its inverse, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[i] = sum over j < i of values[j] * base^j mod 2^64."""
    out = np.zeros(len(values) + 1, np.uint64)
    up, _ = Powers.get(len(values) + 1)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each values[start:end], the same wherever the content stands."""
    _, down = Powers.get(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def gram_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix = prefix_hash(values)
    _, down = Powers.get(len(prefix))
    return mix((prefix[k:] - prefix[:n]) * down[:n])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary Arrow column, and offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 20):
    """Row ranges [a, b) whose bytes stay near limit; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in concatenated rows, and how many words lie before each row (n + 1 values)."""
    solid = ~space[data]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    start[cut] = solid[cut]
    end[cut - 1] = solid[cut - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(byte_values(data)), starts, ends)


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost least value in every window of w values."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, span = x, np.arange(len(x)), 1
    while span < w:
        step = min(span, w - span)
        left, right = best[:-step], best[step:]
        take = right < left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[:-step])
        span += step
    return at


def trim() -> None:
    """Give freed memory back to the system, where the C library can: a worker that is done with a large block keeps none of it."""
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


TABLE_BITS = 24


def bit_table(spark: SparkSession, df: DataFrame, column: str):
    """A broadcast table of 2^TABLE_BITS bits (2 MB whatever the size of df) with the hashes of a long column set.

    It only spares work: what passes it still goes through an exact join.
    """
    n = 1 << TABLE_BITS

    def run(batches):
        table = np.zeros(n, bool)
        for batch in batches:
            table[batch.column(0).to_numpy(zero_copy_only=False)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(n >> 3, np.uint8)
    for r in df.select(F.pmod(F.xxhash64(column), F.lit(n)).cast("int").alias("h")).coalesce(32).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(out.tobytes())


def through_table(df: DataFrame, column: str, table) -> DataFrame:
    """Rows of df whose long column may be in the table."""
    names = df.columns

    def run(batches):
        bits = np.unpackbits(np.frombuffer(table.value, np.uint8)).view(bool)
        for batch in batches:
            keep = bits[batch.column(len(names)).to_numpy(zero_copy_only=False)]
            if keep.any():
                yield batch.select(list(range(len(names)))).filter(pa.array(keep))

    return df.withColumn("_h", F.pmod(F.xxhash64(column), F.lit(1 << TABLE_BITS)).cast("int")).mapInArrow(run, df.schema)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, component (its least node), for edges (a, b), by contraction.

    In each round every node goes to the first of its neighbours and itself in the order of a hash, the edges between
    what is left are put together, and so they dwindle; then the rounds are read backwards. All rounds together read
    a few times the edges, whatever the shape of the components.
    """
    before = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    rest = materialise(spark, edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    rounds = []
    while rest.limit(1).count():
        both = rest.select(F.col("a").alias("node"), F.col("b").alias("other")).union(rest.select(F.col("b").alias("node"), F.col("a").alias("other")))
        first = both.groupBy("node").agg(F.min(before("other")).alias("first")).select("node", F.least("first", before("node"))["n"].alias("parent"))
        rounds.append(materialise(spark, first, "parents"))
        one, two = rounds[-1].select(F.col("node").alias("a"), F.col("parent").alias("x")), rounds[-1].select(F.col("node").alias("b"), F.col("parent").alias("y"))
        rest = rest.join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct()
        rest = materialise(spark, rest, "edges")
    if not rounds:
        return spark.createDataFrame([], "node long, component long")
    label = rounds.pop().withColumnRenamed("parent", "root")
    for parents in reversed(rounds):
        up = label.select(F.col("node").alias("parent"), F.col("root").alias("top"))
        label = materialise(spark, parents.join(up, "parent", "left").select("node", F.coalesce("top", "parent").alias("root")), "roots")
    least = label.groupBy("root").agg(F.min("node").alias("component"))
    return materialise(spark, label.join(least, "root").select("node", "component"), "labels")


def sorted_groups(batches, keys: int):
    """Groups of rows, as Arrow tables, from batches sorted by their first columns (keys of them, longs)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
