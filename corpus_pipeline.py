"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, mixing to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from streamloom.llm import dartminhash, decontam, mixing, pii, toxicity
from streamloom.llm.common import load, materialise, release, written


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.toxic_filter(spark, docs, load(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the one with the least doc_id."""
    return dartminhash.drop_near_duplicates(spark, docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, copied or edited, go."""
    return decontam.decontaminate(spark, docs, load(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are replaced in the text."""
    return pii.redact(spark, docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document and epoch in which the mixture draws it."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", toxic_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: Trained classifiers, signatures and alignments are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again by the next.

    Once a stage is written, what it and the stage before it wrote on the way goes.
    """
    before, docs = set(written()), load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(spark, stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, [p for p in written()[:-1] if p not in before])
    return docs
