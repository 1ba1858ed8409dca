"""Saved scrapes: an archive table of scrape_id, url, ts and the LISTS of a scrape (A2-A5).

The archive is a Parquet table partitioned by a two-character URL hash bucket, so
that loading the scrapes of given URLs prunes partitions.  Writes go to the path the
caller names (a shared folder on a cluster).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TS_FORMAT = "yyyyMMdd_HHmmss"
#: What a scrape holds; all but the products may be missing.
LISTS = ["products", "deduplicated_data", "scraped_content", "chunks", "tagged_chunks"]


def scrape_id(url, ts):
    """'md5(url)_timestamp'."""
    return F.concat(F.md5(url), F.lit("_"), ts)


def _stored(df: DataFrame) -> DataFrame:
    return df.select("scrape_id", "url", "ts", *[c for c in LISTS if c in df.columns])


def upsert(archive: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """A3: add new scrapes (url, ts, products and the other LISTS they have).  A scrape
    without products is refused; a URL already archived keeps its old scrape unless ``force``,
    which replaces it.  Scrapes of one URL in a batch are taken in the order of ts (of the
    products' JSON text for ties): the first stays, with ``force`` the last."""
    pick = F.max_by if force else F.min_by
    lists = [c for c in LISTS if c in new.columns]
    one = new.filter(F.size("products") > 0).groupBy("url").agg(
        pick(F.struct("ts", *lists), F.struct("ts", F.to_json("products"))).alias("s"))
    fresh = one.select(scrape_id(F.col("url"), F.col("s.ts")).alias("scrape_id"), "url", "s.*")
    if force:
        archive = archive.join(fresh.select("url"), "url", "left_anti")
    else:
        fresh = fresh.join(archive.select("url"), "url", "left_anti")
    return _stored(archive).unionByName(_stored(fresh), allowMissingColumns=True)


def index(archive: DataFrame) -> DataFrame:
    """A4: one entry per scrape: id, URL, timestamp, number of products."""
    return archive.select("scrape_id", "url", F.col("ts").alias("timestamp"),
                          F.size("products").alias("products_count"),
                          F.to_timestamp("ts", TS_FORMAT).alias("saved_at"))


def exists(archive: DataFrame, urls: DataFrame) -> DataFrame:
    """For each asked URL whether it is archived and its timestamp."""
    idx = archive.select("url", "ts")
    return urls.select("url").distinct().join(idx, "url", "left").select(
        "url", F.col("ts").isNotNull().alias("saved"), F.col("ts").alias("timestamp"))


def load(archive: DataFrame, urls: DataFrame) -> DataFrame:
    """A2: the saved products of the asked URLs (semi join, one row per product)."""
    hit = archive.join(urls.select("url").distinct(), "url", "left_semi")
    return hit.select("scrape_id", "url", F.posexplode("products").alias("pos", "p")).select(
        "scrape_id", "url", "pos", "p.*")


def write(archive: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store the archive partitioned by URL-hash bucket."""
    (archive.withColumn("bucket", F.substring(F.md5("url"), 1, 2))
     .write.mode(mode).partitionBy("bucket").parquet(path))


def read(spark: SparkSession, path: str, urls: list[str] | None = None, schema=None) -> DataFrame:
    """Read the archive; with ``urls`` only their buckets are scanned.  A cleared archive has no
    file to take columns from, so its ``schema`` is asked for."""
    reader = spark.read if schema is None else spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.StringType())]))
    df = reader.parquet(path)
    if urls:
        import hashlib
        buckets = sorted({hashlib.md5(u.encode()).hexdigest()[:2] for u in urls})
        df = df.filter(F.col("bucket").isin(buckets) & F.col("url").isin(urls))
    return df.drop("bucket")


def clear(spark: SparkSession, path: str, schema) -> None:
    """A5: remove every scrape.  The archive stays a table partitioned by bucket: later scrapes are
    appended with :func:`write`.  One bucket keeps a file without rows, so that the table can be read."""
    none = spark.createDataFrame([], schema)
    write(none, path)
    none.write.mode("append").parquet(f"{path.rstrip('/')}/bucket=ff")
