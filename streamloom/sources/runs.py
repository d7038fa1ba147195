"""Checkpoints of sharded runs, reports, and the protocol that guards a results folder."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V


def append_rows(rows: DataFrame, path: str, rank: int | None = None) -> None:
    """Append rows (key, line, ...) as JSON lines; a shard has a folder of its own. line is the writer's number of the row, and first means the least of it."""
    if "line" not in rows.columns:
        raise ValueError("rows need a line number, by which the first row of a key is known")
    rows.withColumnRenamed("key", "_key").write.mode("append").json(path if rank is None else f"{path}/rank={rank}")


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all shards with key, line and rank (0 where there is one shard)."""
    rows = spark.read.schema(schema.replace("key ", "_key ")).json(path)
    if "rank" not in rows.columns:
        rows = rows.withColumn("rank", F.lit(0))
    return rows.withColumnRenamed("_key", "key")


def done_ranks(spark: SparkSession, path: str, ranks: int) -> list[int]:
    """The shards of a run that were written to their end: Spark marks each with _SUCCESS."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return [r for r in range(ranks) if files.exists(at(f"{path}/rank={r}/_SUCCESS"))]


def bucketed(rows: DataFrame) -> DataFrame:
    """Checkpoint rows (task, ...) with the section they belong to; null for tasks of none."""
    return rows.withColumn("section", F.coalesce(*[F.when(F.col("task").isin(*tasks), F.lit(name)) for name, tasks in V.TASKS.items()]))


#: Columns of a result row, the same for answers, errors and missing videos.
RESULT_ROW = "key string, video string, task string, question string, truth string, response string, route string, error string, status string"


def result_rows(rows: DataFrame) -> DataFrame:
    """rows with the columns of RESULT_ROW, in order; those that are not there are null."""
    fields = [x.split() for x in RESULT_ROW.split(", ")]
    return rows.select(*(F.col(n).cast(t).alias(n) if n in rows.columns else F.lit(None).cast(t).alias(n) for n, t in fields))


def save_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def protocol(settings: dict, inputs: list[str], spark: SparkSession) -> dict:
    """What makes a result comparable: settings, the names, sizes and times of the input files, and versions."""
    files = {}
    for path in inputs:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").cast("string").alias("t"))
        one = rows.agg(F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", "path", "length", "t")), 1, 15), 16, 10).cast("decimal(38,0)")).alias("digest"), F.count("*").alias("n"), F.sum("length").alias("bytes")).first()
        files[path] = {"digest": str(one["digest"]), "files": one["n"], "bytes": one["bytes"]}
    return {"settings": settings, "inputs": files, "spark": spark.version}


class ProtocolMismatch(ValueError):
    pass


def ensure_protocol(folder: str, protocol: dict, spark: SparkSession | None = None) -> None:
    """The folder's results were made under this protocol, or there are none yet; anything else is an error.

    A new protocol file is written whole and then put in its place unless there is one, so of two that start together
    one wins and the other compares. On the driver's file system (no scheme, or file:) this is a link. Any other scheme
    needs the session and goes through Hadoop's FileContext: a rename that does not overwrite, atomic where the store's is.
    """
    want = json.loads(json.dumps({"schema_version": 1, "protocol": protocol}, sort_keys=True))
    if "://" in folder.removeprefix("file://"):
        if spark is None:
            raise ValueError("a protocol outside the driver's file system needs a session")
        found = _placed_by_hadoop(spark, folder, want)
    else:
        found = _placed_by_link(folder.removeprefix("file://"), want)
    if found != want:
        raise ProtocolMismatch(f"{folder} holds results of another protocol")


def _placed_by_link(folder: str, want: dict) -> dict:
    """The protocol of a local folder: want, if it had none."""
    at = Path(folder, "protocol.json")
    if not at.exists():
        os.makedirs(folder, exist_ok=True)
        if any(p.name != "protocol.json" and not p.name.startswith(".") for p in at.parent.iterdir()):
            raise ProtocolMismatch(f"{folder} holds results without a protocol")
        handle, name = tempfile.mkstemp(dir=folder, prefix=".protocol-")
        with os.fdopen(handle, "w") as f:
            json.dump(want, f, indent=2, sort_keys=True)
        try:
            os.link(name, at)
        except FileExistsError:
            pass
        finally:
            os.unlink(name)
    return json.loads(at.read_text())


def _placed_by_hadoop(spark: SparkSession, folder: str, want: dict) -> dict:
    """The protocol of a folder of any file system that Spark reaches: want, if it had none."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs
    here = fs.Path(folder)
    files = here.getFileSystem(spark._jsc.hadoopConfiguration())
    at, own = fs.Path(here, "protocol.json"), fs.Path(here, f".protocol-{uuid.uuid4().hex}")
    if not files.exists(at):
        files.mkdirs(here)
        if any(n != "protocol.json" and not n.startswith(".") for n in (s.getPath().getName() for s in files.listStatus(here))):
            raise ProtocolMismatch(f"{folder} holds results without a protocol")
        out = files.create(own, False)
        out.write(bytearray(json.dumps(want, indent=2, sort_keys=True).encode()))
        out.close()
        keep = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
        keep[0] = getattr(fs, "Options$Rename").NONE
        try:
            fs.FileContext.getFileContext(here.toUri(), spark._jsc.hadoopConfiguration()).rename(own, at, keep)
        except Py4JJavaError:
            if not files.exists(at):  # not the other writer, but the store
                raise
        finally:
            if files.exists(own):
                files.delete(own, False)
    stream = files.open(at)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
