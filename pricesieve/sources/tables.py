"""Input tables: the stored parquet tables every query reads."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stored table; column pruning and filters reach the parquet scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=BASE_TABLES) -> None:
    """Register the stored tables as temporary views for SQL-stated fixtures."""
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)
