"""Benchmark annotations: scans with explicit schemas, validation into an error column, unnesting with stable identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V

OVO_SCHEMA = "id long, task string, video string, question string, options array<string>, gt int, realtime double, activity string, ask_time double, test_info array<struct<realtime: double, count: int, step: string, type: int>>"
STREAM_SCHEMA = "time string, video_path string, video_categories string, questions array<struct<task_type: string, required_ability: string, time_stamp: string, question: string, answer: string, options: array<string>>>"


def read_ovo(spark: SparkSession, path: str) -> DataFrame:
    """Annotations with section, truth letter and error (null for good rows)."""
    return checked_ovo(spark.read.schema(OVO_SCHEMA).option("multiLine", True).json(path))


def checked_ovo(rows: DataFrame) -> DataFrame:
    """rows of OVO_SCHEMA with section, truth and error."""
    section = F.coalesce(*[F.when(F.col("task").isin(*tasks), F.lit(name)) for name, tasks in V.TASKS.items()])
    mcq = section.isin("backward", "realtime")
    n = F.coalesce(F.size("options"), F.lit(0))
    error = (
        F.when(F.col("id").isNull() | (F.col("id") < 0), "id must be a non-negative integer")
        .when(section.isNull(), "unknown task")
        .when(mcq & (F.coalesce(F.trim("question"), F.lit("")) == ""), "blank question")
        .when(mcq & ((n < 2) | (n > 6) | F.exists(F.coalesce("options", F.array().cast("array<string>")), lambda o: F.coalesce(F.trim(o), F.lit("")) == "")), "two to six options, none blank")
        .when(mcq & (F.col("realtime").isNull() | F.isnan("realtime") | (F.col("realtime") < 0)), "cutoff must be finite and not negative")
    )
    return rows.withColumns({"section": section, "truth": F.char(F.col("gt") + 65), "error": error})


def forward_items(rows: DataFrame) -> DataFrame:
    """A row for each sub-test, in the order of cutoffs, with its place in the annotation."""
    out = rows.filter("section = 'forward' and error is null").select("id", "task", "activity", "ask_time", F.posexplode("test_info").alias("place", "t"))
    return out.select("id", "task", "activity", "ask_time", "place", "t.*")


def unnest(rows: DataFrame, key: str, questions: str) -> DataFrame:
    """A row for each nested question: key, place and q."""
    return rows.select(key, F.posexplode(questions).alias("place", "q"))


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A row for each question with occurrence "entry:question" and its video, by places in the file."""
    from ..functions import text as X

    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{_struct(STREAM_SCHEMA)}>>").alias("entries"))
    entries = raw.select(F.posexplode("entries").alias("entry", "e"))
    out = entries.select("entry", "e.*").select("entry", "time", "video_path", F.posexplode("questions").alias("place", "q"))
    return out.select(
        F.concat_ws(":", F.col("entry").cast("string"), F.col("place").cast("string")).alias("occurrence"), "entry", "place", "video_path", F.col("time").alias("time_window"), "q.*", X.timestamp_to_seconds("q.time_stamp").alias("seconds")
    )


def _struct(schema: str) -> str:
    import re

    return re.sub(r"(^|, )(\w+) (?=\w)", r"\1\2: ", schema)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of each file's bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
