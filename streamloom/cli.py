"""Command line: build memories of captions, ask them, and score answers.

    python -m streamloom.cli answer --captions captions.parquet --questions questions.parquet --out run --mode incremental --scorer mine:Scorer
    python -m streamloom.cli merge --out run
    python -m streamloom.cli score --out run --truth truth.parquet

Answers are appended as JSON lines with their keys, so a run that was stopped goes on with what is left; a protocol file
refuses results of other settings in one folder.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from dataclasses import asdict, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .models import scorer as models
from .operators import retrieval as S
from .operators import scoring as H
from .sources import runs

ROW = "key string, line long, video long, qid long, response string, matched boolean, hit_count long"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="streamloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("answer", help="ask memories of captions")
    a.add_argument("--captions", required=True, help="Parquet: video, chunk, ts, caption")
    a.add_argument("--questions", required=True, help="Parquet: video, qid, question")
    a.add_argument("--out", required=True)
    a.add_argument("--top-k", default="dynamic", help="a positive number, or one of " + ", ".join(S.DYNAMIC))
    a.add_argument("--scorer", required=True, help="module:factory of the models")
    a.add_argument("--vectors", help="folder of vectors kept between runs; they belong to the scorer named")
    a.add_argument("--per-video", type=int, default=0, help="at most so many questions of a video (0: all)")
    a.add_argument("--videos", type=int, default=0, help="at most so many videos (0: all)")
    for f in fields(api.MemoryConfig):
        kind = {"int": int, "float": float, "str": str}.get(str(f.type).split(" ")[0])
        if kind:
            a.add_argument("--" + f.name.replace("_", "-"), type=kind, default=f.default)
        else:
            a.add_argument("--no-" + f.name.replace("_", "-"), dest=f.name, action="store_false")
    m = sub.add_parser("merge", help="one row for each key")
    m.add_argument("--out", required=True)
    s = sub.add_parser("score", help="accuracy of merged answers")
    s.add_argument("--out", required=True)
    s.add_argument("--truth", required=True, help="Parquet: video, qid, task, truth")
    return p


def config_of(args: argparse.Namespace) -> api.MemoryConfig:
    return api.MemoryConfig(**{f.name: getattr(args, f.name) for f in fields(api.MemoryConfig)})


def factory_of(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def answered(spark: SparkSession, out: str) -> DataFrame | None:
    """The rows that a run has so far; None before the first."""
    try:
        return runs.read_rows(spark, f"{out}/rows", ROW)
    except Exception as fault:
        if "PATH_NOT_FOUND" in str(fault):
            return None
        raise


def answer(spark: SparkSession, args: argparse.Namespace) -> int:
    """Ask what has no answer yet; the number of answers written."""
    from .operators import chunks as C

    config = config_of(args)
    S.top_k_argument(args.top_k, config.top_k_max)
    runs.ensure_protocol(args.out, runs.protocol(asdict(config) | {"top_k": args.top_k, "scorer": args.scorer}, [args.captions, args.questions], spark), spark)
    asked = spark.read.parquet(args.questions).select("video", "qid", "question")
    if args.per_video or args.videos:
        asked = C.first_n(asked, "video", ["qid"], args.per_video or 1 << 30, args.videos or None)
    keyed = asked.withColumn("key", F.concat_ws(":", F.col("video").cast("string"), F.col("qid").cast("string")))
    done = answered(spark, args.out)
    if done is not None:
        keyed = keyed.join(done.select("key").distinct(), "key", "left_anti")
    n = keyed.count()
    if n:
        memory = api.open_memory(spark, config, factory_of(args.scorer), cache=models.VectorCache(args.vectors, args.scorer) if args.vectors else None).update(spark.read.parquet(args.captions))
        got = memory.answer(keyed.select("video", "qid", "question"), top_k=args.top_k)
        rows = got.select(F.concat_ws(":", F.col("video").cast("string"), F.col("qid").cast("string")).alias("key"), F.xxhash64("video", "qid").alias("line"), "video", "qid", "response", "matched", "hit_count")
        runs.append_rows(rows, f"{args.out}/rows")
    return n


def merged(spark: SparkSession, out: str) -> DataFrame:
    return H.merge_shards(runs.read_rows(spark, f"{out}/rows", ROW))


def score(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    rows = merged(spark, args.out).select("video", "qid", "response")
    truth = spark.read.parquet(args.truth)
    return H.accuracy(truth.join(rows, ["video", "qid"], "left").withColumn("mark", H.mark_mcq(F.col("response"), F.col("truth"))), "task")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("streamloom").getOrCreate()
    if args.command == "answer":
        print(json.dumps({"answered": answer(spark, args)}))
    elif args.command == "merge":
        runs.save_report(merged(spark, args.out), f"{args.out}/merged")
        print(json.dumps({"rows": spark.read.json(f"{args.out}/merged").count()}))
    else:
        for r in score(spark, args).orderBy("task").collect():
            print(json.dumps(r.asDict()))


if __name__ == "__main__":
    main(sys.argv[1:])
