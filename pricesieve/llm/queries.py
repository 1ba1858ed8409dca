"""Registered queries of the operators, with their DuckDB SQL where SQL can state them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricesieve.llm import (
    bestfit, bpe_automaton, golay_simhash, hadamard_kmeans, html_mincut, license_scan, line_crf, line_quality,
    nn_descent, pitman_yor, spelling_groups, token_files, url_rules,
)
from pricesieve.llm.common import public_tokenizer


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract(_table(spark, sf_dir, "pages"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_rules.QUERY_RULES, "host string, path string, verdict string")
    return url_rules.judge(_table(spark, sf_dir, "pages"), rules)


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.digests(_table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"))


def op7_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.packed_documents(_table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_paragraphs(_table(spark, sf_dir, "documents"))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality_rules(_table(spark, sf_dir, "documents"))


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.variant_groups(_table(spark, sf_dir, "documents"))


def op12_hadamard_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hadamard_kmeans.cluster(_table(spark, sf_dir, "embeddings"))


def op13_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scores(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_html_mincut, op2_token_files, op3_url_rules, op4_quality_crf, op5_simhash, op6_bpe_automaton, op7_bestfit,
    op8_license_scan, op9_nn_descent, op10_quality_rules, op11_spelling_groups, op12_hadamard_kmeans, op13_pitman_yor)}
ORACLE = {"op3_url_rules": url_rules.oracle(), "op10_quality_rules": line_quality.ORACLE,
          "op12_hadamard_kmeans": hadamard_kmeans.oracle()}
