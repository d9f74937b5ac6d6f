"""The corpus pipeline: documents through five training-data operators.

Each stage works on all that the one before kept and returns the columns of
``documents``; the last returns doc_id, source, lang, ids and the text that
the ids decode to. Stages never swallow errors.

Defined results: a null text counts as empty (the quality rules reject it), a
null id or source is a value like others, an empty table stays empty, and rows
that repeat id and text are one from exact dedup on. Of groups of copies one
row stays: the longest original text's, then the smallest id's (exact), the
smallest id's (near). Texts of any length are worked off whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import exact_dedup, minhash, mixing, quality_rules, subwords
from tessel.llm.common import stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the production policy rejects."""
    return quality_rules.keep_passing(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the smallest id's."""
    return minhash.dedup(docs, threshold=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to twice, or not at all."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Subword ids of each document, and what they decode to."""
    return subwords.coded(docs)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: Near-duplicate components and subword ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs)
    return docs
