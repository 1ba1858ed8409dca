"""Composed flows: stored answers -> products -> deduplicated catalogue -> statistics."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricesieve import constants as K
from pricesieve.operators import answers, dedup, explore


def catalogue(product_answers: DataFrame, threshold: float = K.SIMILARITY_THRESHOLD) -> DataFrame:
    """Answers of every chunk -> product rows with validated categories -> kept rows of
    the greedy deduplication (with their cluster size)."""
    items = answers.answer_items(product_answers)
    # ids in (chunk, item) order: the stride is longer than the longest answer
    stride = (items.agg(F.max("item_no")).first()[0] or 0) + 1
    products = answers.category_relabel(items).withColumn(
        "row_id", F.col("chunk_id") * F.lit(stride).cast("long") + F.col("item_no")
    ).drop("text")
    return dedup.deduplicate(products, threshold)


def catalogue_category_counts(product_answers: DataFrame) -> DataFrame:
    """Flagship: category distribution of the deduplicated catalogue."""
    return explore.category_counts(catalogue(product_answers))
