"""The registered queries of this subpackage, each over its whole table, and their DuckDB SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annulus, dartminhash, decontam, hpylm, merkle, mixing, ngram, oracles, pii, substring, suffix, tiff, toxicity, warc
from .common import load


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs.select("doc_id", "text"), toxicity.train(spark, docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", *(F.round(c, 6).alias(c) for c in toxicity.CATEGORIES), "rejected")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, load(spark, sf_dir, "pages"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(spark, load(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(load(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.detect(spark, load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "item_id", F.round("score", 6).alias("score"))


def op6_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digest_media(tiff.encode_documents(load(spark, sf_dir, "documents")))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_documents(spark, load(spark, sf_dir, "documents"))


def op8_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.classes(spark, load(spark, sf_dir, "documents"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(spark, load(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return pii.detect(spark, docs, pii.find_disclosing(spark, docs))


def op11_annulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annulus.code_vectors(spark, load(spark, sf_dir, "embeddings"))


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.join_components(spark, load(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(spark, load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_warc, op3_substring, op4_mixing, op5_decontamination, op6_tiff, op7_lm_scoring, op8_dartminhash, op9_suffix_array, op10_pii, op11_annulus, op12_ngram_jaccard, op13_merkle)}

#: Trained models, alignments, TIFF bytes and corpus statistics are beyond SQL; tests hold those queries against brute force.
ORACLE_SQL = {"op2_warc": oracles.WARC, "op3_substring": oracles.SUBSTRING, "op4_mixing": mixing.oracle(), "op8_dartminhash": oracles.NEAR_DUPLICATES, "op9_suffix_array": oracles.SUFFIX, "op11_annulus": annulus.oracle(), "op12_ngram_jaccard": oracles.JACCARD, "op13_merkle": merkle.oracle()}
