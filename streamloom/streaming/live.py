"""The operators on live streams. Events come as (event_id, ts, user_id, event_type, value).

Event time needs a timestamp, so a timestamp without zone is cast (session zone UTC). Rows later than DELAY behind the
newest are dropped; the default is none, as streams here are in order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.stored import shared_folder

DELAY = "0 seconds"


def events(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def chunks(stream: DataFrame, duration: str = "1 day") -> DataFrame:
    """Tumbling chunks of each user."""
    return events(stream).groupBy("user_id", F.window("ts", duration)).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def sliding(stream: DataFrame, duration: str = "2 days", step: str = "1 day") -> DataFrame:
    """Overlapping windows of each user."""
    return events(stream).groupBy("user_id", F.window("ts", duration, step)).agg(F.count("*").alias("n"))


def surviving_chunks(stream: DataFrame, removal: str = "signup") -> DataFrame:
    """Days of each user with their events, but for those that a removal takes back, whenever it comes: counts and removals of a chunk are one state."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    grouped = stream.groupBy("user_id", F.unix_micros(day).alias("day_us")).agg(F.count("*").alias("n"), F.max((F.col("event_type") == removal).cast("int")).alias("removed"))
    return grouped.filter("removed = 0").select("user_id", "day_us", "n")


def sessions(stream: DataFrame, gap: str = "1 day", label: str = "purchase") -> DataFrame:
    """Sessions of a user's peaks; one is given out when the watermark is past its end."""
    peaks = events(stream).filter(F.col("event_type") == label)
    grouped = peaks.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return grouped.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


COUNT_SCHEMA = "user_id long, count long, last_us long"
STATE_SCHEMA = "us binary, delta binary"


def _count(key, batches, state: GroupState):
    # A key's rows come in several frames and micro-batches in any order, so each time is held with the least of its deltas.
    held = [np.frombuffer(x, np.int64) for x in state.get] if state.exists else [np.zeros(0, np.int64)] * 2
    frames = [f[f["us"].notna()] for f in batches]
    us, delta = (np.concatenate([old, *(f[c].to_numpy(np.int64) for f in frames)]) for c, old in zip(("us", "delta"), held, strict=True))
    order = np.lexsort((delta, us))
    us, first = np.unique(us[order], return_index=True)
    delta = delta[order][first]
    state.update((us.tobytes(), delta.tobytes()))
    yield pd.DataFrame({"user_id": [key[0]], "count": [int(delta.sum())], "last_us": [int(us[-1]) if len(us) else -1]})


def running_counts(stream: DataFrame) -> DataFrame:
    """What each event adds, summed by user in keyed state; of events of the same time the one that adds least counts.

    The state holds 16 bytes for each different time of a user, so that an event that comes late still counts.
    """
    delta = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(0)
    rows = stream.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), delta.cast("long").alias("delta"))
    return rows.groupBy("user_id").applyInPandasWithState(_count, COUNT_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, path: str, operator, name: str | None = None) -> DataFrame:
    """Run a stream over files that are there, to its end, into Parquet in the shared folder; the rows it gave out.

    Update mode gives a key's rows anew with each batch; the last of them counts. Sessions run in complete mode, so that
    late rows count and those still open at the end are given out; the last batch has them all.
    """
    import uuid

    schema = spark.read.parquet(path).schema
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    folder, _, leaf = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    stream = source.parquet(f"{folder}/{leaf}*" if leaf.endswith(".parquet") else path)
    out = operator(stream)
    mode = {running_counts: "update", sessions: "complete", chunks: "complete", sliding: "complete", surviving_chunks: "complete"}.get(operator, "append")
    epochs = []

    def sink(df: DataFrame, epoch: int) -> None:
        epochs.append(epoch)
        df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    query = out.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "complete":
        return spark.read.schema(out.schema).parquet(f"{base}/out/epoch={max(epochs)}")
    rows = spark.read.schema(out.schema).parquet(f"{base}/out")
    if mode == "append":
        return rows.drop("epoch")
    return rows.groupBy("user_id").agg(F.max(F.struct("epoch", "count", "last_us")).alias("r")).select("user_id", "r.count", "r.last_us")
