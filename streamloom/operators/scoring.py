"""Marks, accuracies, summaries, and the bookkeeping of sharded runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V


def mark_mcq(response: Column, truth: Column) -> Column:
    return F.coalesce((X.mcq_letter(response) == F.upper(truth)).cast("int"), F.lit(0))


def mark_count(response: Column, truth: Column) -> Column:
    """All digits of the response, put together, are the count."""
    digits = F.regexp_replace(F.coalesce(response, F.lit("")), "[^0-9]", "")
    return ((digits != "") & (digits == truth.cast("string"))).cast("int")


def mark_yes_no(response: Column, truth: Column) -> Column:
    """By substring, so KNOWN is a no."""
    up = F.upper(F.trim(F.coalesce(response, F.lit(""))))
    no, yes = (up == "N") | up.contains("NO"), (up == "Y") | up.contains("YES")
    return ((no & (truth == 0)) | (yes & (truth == 1))).cast("int")


def forward_marks(items: DataFrame) -> DataFrame:
    """items: task, response, count, type. REC by count, SSR and CRR by type."""
    mark = F.when(F.col("task") == "REC", mark_count(F.col("response"), F.col("count"))).otherwise(mark_yes_no(F.col("response"), F.col("type")))
    return items.filter(F.col("task").isin(*V.TASKS["forward"])).withColumn("mark", mark)


def accuracy(rows: DataFrame, *by: str) -> DataFrame:
    """rows: mark and the columns of by. correct, total and accuracy in percent."""
    return rows.groupBy(*by).agg(F.sum("mark").alias("correct"), F.count("*").alias("total"), F.round(100.0 * F.sum("mark") / F.count("*"), 6).alias("accuracy"))


def macro_average(rows: DataFrame, section: str, task: str, expected: int) -> DataFrame:
    """The mean of task accuracies by section, and over all (section null) only if every expected task is there."""
    tasks = accuracy(rows, section, task)
    sections = tasks.groupBy(section).agg(F.avg(F.col("accuracy")).alias("mean"), F.count("*").alias("n_tasks"))
    whole = sections.agg(F.avg("mean").alias("mean"), F.sum("n_tasks").alias("n_tasks")).filter(F.col("n_tasks") == expected)
    return sections.unionByName(whole.withColumn(section, F.lit(None).cast("string"))).withColumn("mean", F.round("mean", 6))


def summary(rows: DataFrame, route: str, task: str, error: str) -> DataFrame:
    """Overall, by route and by task, in one pass of grouping sets; blanks are unknown, errors are counted and stay in the total."""
    clean = rows.select(*(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown")).alias(n) for c, n in ((route, "route"), (task, "task"))), "mark", F.col(error).cast("int").alias("error"))
    return clean.groupingSets([[], ["route"], ["task"]], "route", "task").agg(F.sum("mark").alias("correct"), F.count("*").alias("total"), F.sum("error").alias("errors"))


def histogram(rows: DataFrame) -> DataFrame:
    return rows.groupingSets([["route"], ["task", "route"]], "task", "route").agg(F.count("*").alias("n"))


def scoreboard(rows: DataFrame, methods: list[str]) -> DataFrame:
    """rows: a column of marks for each method. method, correct, total."""
    return rows.unpivot([], methods, "method", "mark").filter("mark is not null").groupBy("method").agg(F.sum("mark").alias("correct"), F.count("*").alias("total"))


def merge_shards(rows: DataFrame) -> DataFrame:
    """rows: key, rank, line and others. The first row of each key by rank and line; rows without a key go.

    min over a struct is a partial aggregate, so a key that is everywhere costs one row a task.
    """
    rest = [c for c in rows.columns if c not in ("key", "rank", "line")]
    return rows.filter("key is not null").groupBy("key").agg(F.min(F.struct("rank", "line", *rest)).alias("_r")).select("key", *[F.col(f"_r.{c}").alias(c) for c in ("rank", "line", *rest)])


def remaining(expected: DataFrame, done: DataFrame) -> DataFrame:
    """Expected keys that no row has yet."""
    return expected.join(done.select("key"), "key", "left_anti")


def coverage(expected: DataFrame, rows: DataFrame) -> DataFrame:
    """Keys that are missing, not expected, or there more than once; none means full coverage."""
    got = rows.groupBy("key").agg(F.count("*").alias("n"))
    both = expected.select("key", F.lit(1).alias("want")).join(got, "key", "full_outer")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return both.withColumn("fault", fault).filter("fault is not null").select("key", "fault", F.coalesce("n", F.lit(0)).alias("n"))


def seeded_sample(rows: DataFrame, split: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each split in the order of md5(seed:key): the same rows wherever and however it runs."""
    order = Window.partitionBy(split).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
