"""Thresholds by model: lookups small by construction, so they are literal rows, broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V


def model_type(c: Column | str) -> Column:
    low = F.lower(F.col(c) if isinstance(c, str) else c)
    return F.when(low.rlike("qwen[-_]?2[._]?5"), "qwen2_5_vl").when(low.rlike("qwen[-_]?3"), "qwen3_vl").otherwise("*")


def ovo_profiles(rows: DataFrame, model: str) -> DataFrame:
    """Adds floor, strict and k_max."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(k, *v) for k, v in V.OVO_PROFILES.items()], "kind string, floor double, strict double, k_max int")
    kind = F.when(model_type(model).isin(*[k for k in V.OVO_PROFILES if k != "*"]), model_type(model)).otherwise("*")
    return rows.withColumn("kind", kind).join(F.broadcast(known), "kind").drop("kind")


def stream_profiles(rows: DataFrame, model: str, recent: str, mode: str | None = None) -> DataFrame:
    """Adds floor, strict, k_max and attach; unknown models, windows and non-default memory modes get the default."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(k, n, *v) for (k, n), v in V.STREAM_PROFILES.items()], "kind string, window int, floor double, strict double, k_max int, attach double")
    keys = [F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in V.STREAM_PROFILES if k != "*"]
    own = F.struct(model_type(model).alias("k"), F.col(recent).cast("int").alias("n"))
    usual = F.array_contains(F.array(*keys), own)
    if mode:
        usual &= F.col(mode) == "entity_resolved"
    rows = rows.withColumns({"kind": F.when(usual, model_type(model)).otherwise("*"), "window": F.when(usual, F.col(recent).cast("int")).otherwise(0)})
    return rows.join(F.broadcast(known), ["kind", "window"]).drop("kind", "window")
