"""Live operators whose state stays bounded: by open windows, by rows the watermark has not passed, by a recent buffer.

Rows come as (user_id, us, id, what, amount) under a watermark on event time; `rows_of` makes them from events. What comes
behind the watermark is not dropped without a word: it comes out with kind "late", to be kept in a table beside the
results. A timer at event time gives out what is complete and lets its state go, so results don't depend on how rows are
dealt over files and micro-batches, as long as none is late.

`deliver` writes each epoch once, under the query's name: a run that was stopped goes on from its checkpoint and writes
the epoch it was in again, over the same folder. Only epochs that are whole are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "user_id long, kind string, id long, us long, n long, first_us long, last_us long, ids array<long>"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Fold = Callable[[Any, list[tuple], int], tuple[Any, list[dict]]]


def rows_of(stream: DataFrame, delay: str, what: str = "event_type", amount=None) -> DataFrame:
    """Events under a watermark: user_id, us (microseconds), id, what, amount. Rows without a time or user are left out."""
    timed = stream.filter("ts is not null and user_id is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    value = F.lit(0) if amount is None else amount
    return timed.select("user_id", F.unix_micros("ts").alias("us"), F.col("event_id").alias("id"), F.col(what).alias("what"), value.cast("long").alias("amount"))


def once(stream: DataFrame, delay: str, keys: list[str]) -> DataFrame:
    """Rows of the same keys within the watermark's delay count once; keys older than that are forgotten."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def given_out(key: tuple, rows: list[dict]) -> pd.DataFrame:
    """Rows of OUT."""
    found = {c: pd.array([r.get(c) for r in rows], dtype="Int64") for c in ("id", "us", "n", "first_us", "last_us")}
    found |= {"user_id": pd.array([key[0]] * len(rows), dtype="Int64"), "kind": [r["kind"] for r in rows], "ids": pd.Series([r.get("ids") for r in rows], dtype=object)}
    return pd.DataFrame(found, columns=COLUMNS)


def mark_of(timers) -> int:
    """The watermark in microseconds."""
    return max(timers.getCurrentWatermarkInMs(), 0) * 1000


class Windows(StatefulProcessor):
    """Windows of width microseconds that start each step; a window comes out when the watermark is past its end, and is forgotten."""

    def __init__(self, width: int, step: int) -> None:
        self.width, self.step = width, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start long", "n long, first long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, late, found = mark_of(timerValues), [], {}
        for frame in rows:
            for us, i in zip(frame["us"].tolist(), frame["id"].tolist(), strict=True):
                start = us - us % self.step
                if start + self.width <= mark:  # its last window is closed
                    late.append({"kind": "late", "id": i, "us": us})
                while start + self.width > us:
                    if start + self.width > mark:
                        n, first, last = found.get(start, (0, us, us))
                        found[start] = (n + 1, min(first, us), max(last, us))
                    start -= self.step
        for start, (n, first, last) in found.items():
            if self.open.containsKey((start,)):
                had = self.open.getValue((start,))
                n, first, last = n + had[0], min(first, had[1]), max(last, had[2])
            self.open.updateValue((start,), (n, first, last))
            self.handle.registerTimer(-(-(start + self.width) // 1000))
        if late:
            yield given_out(key, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = mark_of(timerValues)
        closed = [(k[0], tuple(v)) for k, v in self.open.iterator() if k[0] + self.width <= mark]
        for start, _ in closed:
            self.open.removeKey((start,))
        if closed:
            yield given_out(key, [{"kind": "window", "us": s, "n": n, "first_us": a, "last_us": b} for s, (n, a, b) in sorted(closed)])

    def close(self) -> None:
        pass


class InOrder(StatefulProcessor):
    """Rows are held until the watermark has passed them and then folded in the order of time: fold(state, rows, mark) gives the new state and rows to give out."""

    def __init__(self, fold: Fold, schema: str, start: tuple) -> None:
        self.fold, self.schema, self.start = fold, schema, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "us long, id long, what string, amount long")
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, late, fresh = mark_of(timerValues), [], []
        for frame in rows:
            for row in frame[["us", "id", "what", "amount"]].itertuples(index=False, name=None):
                (late if row[0] < mark else fresh).append(row)
        if fresh:
            self.held.appendList(fresh)
            self.handle.registerTimer(min(r[0] for r in fresh) // 1000 + 1)
        if late:
            yield given_out(key, [{"kind": "late", "id": r[1], "us": r[0]} for r in late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = mark_of(timerValues)
        rows = sorted((tuple(r) for r in self.held.get()), key=lambda r: r[:2])
        ready, rest = [r for r in rows if r[0] < mark], [r for r in rows if r[0] >= mark]
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.held.clear()
        if ready:
            state, out = self.fold(tuple(self.state.get()) if self.state.exists() else self.start, ready, mark)
            self.state.update(state)
            if out:
                yield given_out(key, out)

    def close(self) -> None:
        pass


def process(rows: DataFrame, processor: StatefulProcessor) -> DataFrame:
    """Rows of OUT, keyed by user."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.groupBy("user_id").transformWithStateInPandas(processor, OUT, "Append", "EventTime")


def windows(rows: DataFrame, width: int, step: int | None = None) -> DataFrame:
    """kind "window": us (start), n, first_us, last_us of each window of a user that is over; kind "late": rows all of whose windows are."""
    return process(rows, Windows(width, step or width))


def _count(state: tuple, rows: list[tuple], mark: int) -> tuple:
    least: dict[int, int] = {}
    for us, _, _, amount in rows:
        least[us] = min(amount, least.get(us, amount))
    state = (state[0] + sum(least.values()), max(least))
    return state, [{"kind": "count", "us": state[1], "n": state[0]}]


def counts(rows: DataFrame) -> DataFrame:
    """kind "count": what rows add, summed up to us; of rows of the same time the one that adds least counts. The state is one sum, and rows that the watermark has not passed."""
    return process(rows, InOrder(_count, "count long, last long", (0, -1)))


class Cooldown:
    """A positive amount is accepted unless one was within the gap before."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def __call__(self, state: tuple, rows: list[tuple], mark: int) -> tuple:
        last, total, out = *state, []
        for us, i, _, amount in rows:
            if amount > 0 and (last < 0 or us - last > self.gap):
                last, total = us, total + amount
                out.append({"kind": "accepted", "id": i, "us": us, "n": total})
        return (last, total), out


def cooldown(rows: DataFrame, gap: int) -> DataFrame:
    """kind "accepted": each accepted row and the sum so far."""
    return process(rows, InOrder(Cooldown(gap), "last long, total long", (-1, 0)))


class Recent:
    """The frames of the last `window` chunks that are over, and of the open one; what falls out goes to memory."""

    def __init__(self, window: int, width: int, asks: str) -> None:
        self.window, self.width, self.asks = window, width, asks

    def __call__(self, state: tuple, rows: list[tuple], mark: int) -> tuple:
        chunks, sizes, ids = (list(x) for x in state)
        held, at = [], 0
        for c, k in zip(chunks, sizes, strict=True):
            held.append((c, ids[at : at + k]))
            at += k
        out: list[dict] = []
        for us, i, what, _ in rows:
            self.evict(held, us, out)
            if what == self.asks:
                over = [h for h in held if (h[0] + 1) * self.width <= us]
                out.append({"kind": "context", "id": i, "us": us, "n": len(over), "ids": [x for h in over for x in h[1]]})
                continue
            if not held or held[-1][0] != us // self.width:
                held.append((us // self.width, []))
            held[-1][1].append(i)
        self.evict(held, mark - 1, out)
        return ([c for c, _ in held], [len(f) for _, f in held], [x for _, f in held for x in f]), out

    def evict(self, held: list[tuple], now: int, out: list[dict]) -> None:
        """A chunk goes when the chunk `window` places later is over."""
        while len(held) > self.window and (held[self.window][0] + 1) * self.width <= now:
            chunk, frames = held.pop(0)
            out.append({"kind": "evicted", "id": chunk, "us": (held[self.window - 1][0] + 1) * self.width, "n": len(frames), "ids": frames})


def recent(rows: DataFrame, window: int, width: int, asks: str = "question") -> DataFrame:
    """A live buffer of the last `window` chunks of each user, `width` microseconds each.

    kind "evicted": a chunk (id) with its frames (ids), when (us) the one `window` places later is over and it passes on
    to memory. kind "context": for a row whose what is `asks`, the frames of the last chunks over at that time. The state
    holds window + 1 chunks, and rows that the watermark has not passed.
    """
    return process(rows, InOrder(Recent(window, width, asks), "chunks array<long>, sizes array<long>, ids array<long>", ([], [], [])))


def source(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder (or of one file), so many in a micro-batch."""
    folder, _, leaf = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet")
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(f"{folder}/{leaf}*" if leaf.endswith(".parquet") else path)


def deliver(out: DataFrame, name: str, folder: str, mode: str = "append", before_commit: Callable[[int], None] | None = None) -> DataFrame:
    """Run a stream until nothing is left and return all it ever delivered under this name and folder.

    The checkpoint and the epochs stay in the folder: the next call with both goes on where this one ended, or stopped.
    before_commit is called when an epoch is written, before the stream takes note of it.
    """
    spark = out.sparkSession
    base = f"{folder.rstrip('/')}/{name}"

    def sink(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/epochs/epoch={epoch}")
        if before_commit:
            before_commit(epoch)

    query = out.writeStream.queryName(name).outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return delivered(spark, name, folder, out.schema)


def delivered(spark: SparkSession, name: str, folder: str, schema) -> DataFrame:
    """The rows of all whole epochs."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}/epochs/epoch=*/_SUCCESS")
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root) or []
    whole = [s.getPath().getParent().toString() for s in found]
    return spark.read.schema(schema).parquet(*whole) if whole else spark.createDataFrame([], schema)
