"""Corpus pipeline: quality rules, quality classifier, SimHash near-dedup, best-fit packing.

Each stage gets what its predecessor kept, written as Parquet and read again.  All stages but
the last return the columns of ``documents``; the last returns the places of all pieces.

Defined results: a null or empty text fails the base rules and goes in the first stage; rows that
repeat a doc_id are judged row by row, each by its own text, and of rows with near texts one stays,
that of the least doc_id (rows without one last); null sources form one host; a classifier without
labels of both classes gives every document the share of good labels as its score; extra
columns pass through the first three stages; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricesieve.llm import bestfit, golay_simhash, line_crf, line_quality
from pricesieve.llm.common import public_tokenizer, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not mostly host boilerplate, without the
    boilerplate lines of their host."""
    return line_quality.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field, trained on the labelled documents, predicts good."""
    folder = sf_dir.rstrip("/")
    train = spark.read.parquet(f"{folder}/documents.parquet")
    return line_crf.keep_good(docs, train, spark.read.parquet(f"{folder}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of each SimHash component."""
    return golay_simhash.keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, with sequence and offset."""
    return bestfit.packed_documents(docs, public_tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: The classifier and the packing can't be stated in SQL; tests hold run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
