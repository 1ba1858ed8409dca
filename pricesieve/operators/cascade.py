"""Extractor cascade per chunk (D29, D30): the first extractor that yields rows wins.

Order (as in the original): for fuel-retailer chunks the line-position pairing of the
one named site layout, the text-node pairing, the nearest-line pairing and the general
fuel patterns; then, for booking URLs, service cards and provider patterns; then the
fuel category pre-scan when the chunk's style is 'fuel_prices'; finally the stored
model answers.  Every extractor runs over all candidate chunks at once; a union with a
priority column and a per-chunk minimum (one window) keep only the winning extractor's rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricesieve import constants as K
from pricesieve.operators import answers, booking, fuel
from pricesieve.session import materialize

COLS = ["chunk_id", "product_name", "price", "category", "description", "source_url", "provider"]


def _norm(df: DataFrame, priority: int, source: str) -> DataFrame:
    if "provider" not in df.columns:
        df = df.withColumn("provider", F.lit(None).cast("string"))
    return df.select(*COLS).withColumn("priority", F.lit(priority)).withColumn("extracted_by", F.lit(source))


def cascade(chunks: DataFrame, answer_table: DataFrame | None = None) -> DataFrame:
    """``chunks``: (chunk_id, url, text); ``answer_table``: (chunk_id, response) stored model
    answers, used for chunks no rule answered."""
    # every extractor reads the chunks: materialise them once (reliable checkpoint), with what each
    # asks of a chunk, and dealt evenly however few splits their tables were read in
    book = F.lit(False)
    for w in K.BOOKING_URL_WORDS:
        book = book | F.col("url").contains(w)
    n_part = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = materialize(chunks.select("chunk_id", "url", "text").repartition(n_part).select(
        "chunk_id", "url", "text", fuel.is_fuel_chunk(F.col("url"), F.col("text")).alias("is_fuel"), book.alias("is_booking"),
        (fuel.style(F.col("text")) == "fuel_prices").alias("is_styled")))
    fc = c.filter("is_fuel").select("chunk_id", "url", "text")
    loves = fc.filter(F.col("url").contains(K.LOVES_LOCATIONS))
    bc = c.filter("is_booking").select(F.col("chunk_id").alias("page_id"), "url", F.col("text").alias("html"))
    styled = c.filter("is_styled").select("chunk_id", "url", "text")
    parts = [
        _norm(fuel.fuel_price_above(loves), 1, "fuel_above"),
        _norm(fuel.fuel_price_nodes(fc), 2, "fuel_nodes"),
        _norm(fuel.fuel_price_near(fc), 3, "fuel_near"),
        _norm(fuel.fuel_regex(fc), 4, "fuel_regex"),
        _norm(booking.booking_cards(bc).withColumnRenamed("page_id", "chunk_id"), 5, "booking_cards"),
        _norm(booking.booking_regex(bc).withColumnRenamed("page_id", "chunk_id"), 6, "booking_regex"),
        _norm(fuel.fuel_patterns(styled), 7, "fuel_patterns"),
    ]
    if answer_table is not None:
        a = c.select("chunk_id", "url", "text").join(answer_table.select("chunk_id", "response"), "chunk_id")
        items = answers.category_relabel(answers.answer_items(a))
        parts.append(_norm(items, 8, "model_answer"))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    # the rows of one chunk meet in one window, so each extractor stands once in the plan
    best = F.min("priority").over(Window.partitionBy("chunk_id"))
    return u.withColumn("best", best).filter("priority = best").drop("best")
