"""Media manifests: validation as columns, and the status of each video's source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "schema_version int, entries map<string, struct<original_path: string, original_sha256: string, input_path: string, input_sha256: string, verified_until: double, unavailable_after: double>>"
SHA = "^[0-9a-f]{64}$"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """video, the fields of each entry, and error (null for good entries)."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return checked_entries(rows.select("schema_version", F.explode("entries").alias("video", "e")).select("schema_version", "video", "e.*"))


def checked_entries(entries: DataFrame) -> DataFrame:
    """Entries with error: what is wrong with a row, or that its video has several rows."""
    w = Window.partitionBy("video")
    error = (
        F.when(F.coalesce(F.col("schema_version"), F.lit(0)) != 1, "schema_version must be 1")
        .when(F.count("*").over(w) > 1, "a video has one entry")
        .when(~F.coalesce(F.col("original_sha256").rlike(SHA) & F.col("input_sha256").rlike(SHA), F.lit(False)), "SHA-256 expected")
        .when(F.col("verified_until").isNull() | ~F.col("verified_until").eqNullSafe(F.col("unavailable_after")) | (F.col("verified_until") < 0), "verified_until and unavailable_after must be one time")
    )
    return entries.withColumn("error", error)


def verify_files(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """Adds verified: the input file's digest (path, sha256) is the one the manifest names."""
    found = digests.select(F.col("path").alias("input_path"), F.col("sha256"))
    return manifest.join(found, "input_path", "left").withColumn("verified", F.coalesce(F.col("sha256") == F.col("input_sha256"), F.lit(False))).drop("sha256")


def source_status(asked: DataFrame, manifest: DataFrame) -> DataFrame:
    """asked (video, ts): original, missing, or verified_prefix; unavailable if asked after what is verified.

    manifest (video, verified_until): a video without a row is missing, one without an end is original.
    """
    rows = asked.join(manifest.select("video", "verified_until", F.lit(True).alias("known")), "video", "left")
    status = F.when(F.col("known").isNull(), "missing").when(F.col("verified_until").isNotNull(), "verified_prefix").otherwise("original")
    return rows.withColumns({"status": status, "unavailable": F.coalesce((status == "verified_prefix") & (F.col("ts") > F.col("verified_until")), F.lit(False))}).drop("known")
