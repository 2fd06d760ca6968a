"""A training-data pipeline: quality, lines, near duplicates, benchmark passages, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept.
All but the last return the columns of ``documents``; the last adds ``ids`` and ``lossless``.

Defined results: a null, empty or blank text has no words and goes with the first stage, so no
later one meets it in ``run``; a stage called by itself keeps such rows unless its own line says
otherwise. Rows with equal ``doc_id`` are judged one by one by the first, fourth and last stage,
are one document to the second if their texts are equal, and one of them stays in the third.
Null ids are kept and never the reason for a row to go. An empty table stays empty. Other columns
go through unchanged, but for those that the last stage adds, which replace columns of their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemarks.llm import contamination, lines, pieces, quality, simhash
from sitemarks.llm.common import table
from sitemarks.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the current policy go; those without words fail one."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar lines the first stays; documents left without a word go."""
    return lines.dedup_lines(docs).filter(r"text rlike '[^\\x20\\x09-\\x0D]'")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of close fingerprints one document stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the rest, the benchmark's passages go."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their tokens, and whether these decode to the text (a null text has null ids)."""
    model = pieces.load_model(pieces.default_model(spark))
    both = pieces.decode(pieces.encode(docs, model), model, out="_llm_decoded")
    return both.withColumn("lossless", F.col("_llm_decoded").eqNullSafe(F.col("text"))).drop("_llm_decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Fingerprints and tokens are beyond SQL; ``tests/llm/test_pipeline.py`` holds each stage of ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
