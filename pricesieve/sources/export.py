"""Exports and other sinks: CSV, JSON lines, the vector collection, binary files."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricesieve.session import ensure_checkpoint_dir


def export_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/exports/{name}-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, no index column."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read an export back; every column as text, empty fields as nulls."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def write_json(df: DataFrame, path: str, drop=("b64_data",)) -> None:
    """JSON lines with the binary payload column dropped."""
    df.drop(*[c for c in drop if c in df.columns]).write.mode("overwrite").json(path)


def vector_rows(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks paired with their embeddings (chunks without one dropped); id = dense
    position among the stored chunks in chunk order, as text; metadata values as text
    with the tag defaults."""
    from pricesieve.operators.explore import running_totals
    j = chunks.join(embeddings.select("chunk_id", "embedding"), "chunk_id").filter(F.col("embedding").isNotNull())
    j = running_totals(j, "chunk_id", {"_n": F.lit(1)})

    def pybool(c):
        return F.when(F.coalesce(c, F.lit(False)), F.lit("True")).otherwise(F.lit("False"))

    meta = F.create_map(
        F.lit("text"), F.col("text"), F.lit("url"), F.col("url"),
        F.lit("has_product_info"), pybool(F.col("has_product_info")),
        F.lit("has_price_info"), pybool(F.col("has_price_info")),
        F.lit("confidence"), F.coalesce(F.col("confidence"), F.lit(0.0)).cast("string"),
        F.lit("reasoning"), F.coalesce(F.col("reasoning"), F.lit("No reasoning provided")),
    )
    return j.select((F.col("_n") - 1).cast("string").alias("id"), "chunk_id", "embedding", meta.alias("metadata"))


def write_vectors(rows: DataFrame, path: str) -> None:
    """Append the rows to the collection (Parquet)."""
    rows.write.mode("append").parquet(path)


#: Files up to this size are read whole, by one task each.
WHOLE_BYTES = 64 << 20
#: Names by which a text scan would decompress a file.
PACKED = "*.{gz,bz2,zst,lz4,snappy,deflate,xz}"
PDF = bytearray(b"%PDF")


def _stored_files(spark: SparkSession, pattern: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader if glob is None else reader.option("pathGlobFilter", glob)).load(pattern)


def _long_heads(spark: SparkSession, pattern: str) -> DataFrame:
    """(at, is_pdf) of the files over WHOLE_BYTES, scanned as text in splits: a file's first line is the
    first row of its first split.  A byte order mark before the signature is not seen."""
    lines = spark.read.option("lineSep", "\n").text(pattern).filter(F.col("_metadata.file_size") > WHOLE_BYTES)
    lines = lines.select(F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("no"),
                         F.substring(F.col("value").cast("binary"), 1, 4).alias("head"))
    return lines.filter("start = 0").groupBy("at").agg((F.min_by("head", "no") == F.lit(PDF)).alias("is_pdf"))


def binary_catalogue(spark: SparkSession, pattern: str) -> DataFrame:
    """Files with their size and whether they start with the PDF signature; the bytes
    are read by the scan but not decoded.  A file over WHOLE_BYTES is read in splits, so that no task
    holds it; one under a compressed name can't be split and is read whole."""
    at = F.col("_metadata.file_path").alias("at")
    names = F.regexp_extract("path", r"([^/]+)$", 1).alias("file")
    signed = (F.substring("content", 1, 4) == F.lit(PDF)).alias("is_pdf")
    large = F.col("length") > WHOLE_BYTES
    small = _stored_files(spark, pattern).filter(F.col("length") <= WHOLE_BYTES).select(names, "length", signed)
    packed = _stored_files(spark, pattern, PACKED).filter(large)
    plain = _stored_files(spark, pattern).filter(large).select(at, names, "length") \
        .join(packed.select(at), "at", "left_anti").join(_long_heads(spark, pattern), "at", "left")
    return small.unionByName(packed.select(names, "length", signed)).unionByName(
        plain.select("file", "length", F.coalesce("is_pdf", F.lit(False)).alias("is_pdf")))
