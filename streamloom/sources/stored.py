"""Intermediate tables in the folder that driver and executors share, written once and read by several branches."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where all is one machine, a temporary folder if it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
        found = _OWN.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="streamloom-")
        _OWN[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: what several branches need is computed once, and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
