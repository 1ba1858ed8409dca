"""Incremental processing of newly stored pages with Structured Streaming.

The original application is batch only.  The row-wise operators here (page text,
links, chunks, tags) carry no state, so the same functions run unchanged on a
streaming DataFrame of pages arriving as Parquet files: each micro-batch is written
to the sink with exactly-once file output and a checkpoint in the shared folder.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricesieve.operators import links, text

PAGE_SCHEMA = "page_id long, url string, html string"


def page_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """New Parquet files of (page_id, url, html) in ``folder``."""
    return spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(folder)


def page_chunks(pages: DataFrame, size: int = 500, overlap: int = 200) -> DataFrame:
    """Stateless: page text (block form) cut into chunks."""
    t = text.html_blocks(pages)
    return text.chunks(t.withColumnRenamed("page_id", "doc_id"), key="doc_id", text="text", url="url",
                       size=size, overlap=overlap)


def page_links(pages: DataFrame) -> DataFrame:
    """Stateless: distinct absolute links of each page."""
    return links.links_distinct(links.links_absolute(links.links_raw(pages)))


def start(df: DataFrame, out: str, checkpoint: str, trigger_once: bool = True):
    """Write the stream as Parquet (file sink: exactly once) with its checkpoint."""
    w = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")
    return w.start()


def links_per_batch(df: DataFrame) -> DataFrame:
    """A per-micro-batch summary (links per host) for ``foreachBatch`` sinks."""
    from pricesieve.functions.urls import netloc
    return df.groupBy(netloc(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n_links"))
