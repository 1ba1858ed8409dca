"""Registered queries for stored pages, the archive and the exports (group A)."""
from __future__ import annotations

from pyspark.sql import functions as F

from pricesieve.operators import answers
from pricesieve.plans.fixtures import fixture
from pricesieve.plans.q_answers import tags_sql
from pricesieve.plans.registry import register
from pricesieve.sources import archive, export
from pricesieve.sources.tables import read_table


@register("scan_pages", [], """
SELECT page_id, url, length(html) AS html_chars FROM pages""")
def q_scan_pages(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", "url", F.length("html").alias("html_chars"))


_ARCH = ["fx_archive", "fx_new_scrapes"]


def _fresh(order: str) -> str:
    """New scrapes with products, the first (ASC) or last (DESC) of each URL."""
    return f"""(SELECT md5(url) || '_' || ts AS scrape_id, * FROM fx_new_scrapes WHERE len(products) > 0
                QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts {order}) = 1)"""


@register("archive_upsert", _ARCH, f"""
SELECT scrape_id, url, ts, len(products) AS products_count FROM fx_archive
UNION ALL SELECT scrape_id, url, ts, len(products) FROM {_fresh('ASC')} f
WHERE url NOT IN (SELECT url FROM fx_archive)""")
def q_archive_upsert(spark, sf):
    u = archive.upsert(fixture(spark, sf, "fx_archive"), fixture(spark, sf, "fx_new_scrapes"), force=False)
    return u.select("scrape_id", "url", "ts", F.size("products").alias("products_count"))


@register("archive_replace", _ARCH, f"""
SELECT scrape_id, url, ts, len(products) AS products_count FROM fx_archive
WHERE url NOT IN (SELECT url FROM {_fresh('DESC')} f)
UNION ALL SELECT scrape_id, url, ts, len(products) FROM {_fresh('DESC')} f""")
def q_archive_replace(spark, sf):
    u = archive.upsert(fixture(spark, sf, "fx_archive"), fixture(spark, sf, "fx_new_scrapes"), force=True)
    return u.select("scrape_id", "url", "ts", F.size("products").alias("products_count"))


@register("archive_index", ["fx_archive"], """
SELECT scrape_id, url, ts AS timestamp, len(products) AS products_count,
       strptime(ts, '%Y%m%d_%H%M%S') AS saved_at FROM fx_archive""")
def q_archive_index(spark, sf):
    return archive.index(fixture(spark, sf, "fx_archive"))


@register("archive_exists", _ARCH, """
SELECT u.url, a.ts IS NOT NULL AS saved, a.ts AS timestamp
FROM (SELECT DISTINCT url FROM fx_new_scrapes) u LEFT JOIN fx_archive a ON u.url = a.url""")
def q_archive_exists(spark, sf):
    return archive.exists(fixture(spark, sf, "fx_archive"), fixture(spark, sf, "fx_new_scrapes"))


@register("archive_load", _ARCH, """
SELECT scrape_id, url, i - 1 AS pos, products[i].product_name AS product_name, products[i].price AS price,
       products[i].category AS category
FROM (SELECT * FROM fx_archive WHERE url IN (SELECT url FROM fx_new_scrapes)) a,
     generate_series(1, len(products)) AS g(i)""")
def q_archive_load(spark, sf):
    return archive.load(fixture(spark, sf, "fx_archive"), fixture(spark, sf, "fx_new_scrapes"))


@register("archive_roundtrip", ["fx_archive"], """
SELECT scrape_id, url, ts, len(products) AS products_count FROM fx_archive""")
def q_archive_roundtrip(spark, sf):
    path = export.export_dir(spark, "archive")
    archive.write(fixture(spark, sf, "fx_archive"), path)
    return archive.read(spark, path).select("scrape_id", "url", "ts", F.size("products").alias("products_count"))


@register("archive_cleared", _ARCH, f"""
SELECT scrape_id, url, ts, len(products) AS products_count FROM {_fresh('ASC')} f""")
def q_archive_cleared(spark, sf):
    """A5: an archive emptied, then filled with the new scrapes and read from its buckets."""
    path = export.export_dir(spark, "archive_cleared")
    old = fixture(spark, sf, "fx_archive")
    archive.write(old, path)
    archive.clear(spark, path, old.schema)
    empty = archive.read(spark, path, schema=old.schema)
    archive.write(archive.upsert(empty, fixture(spark, sf, "fx_new_scrapes")), path, mode="append")
    return archive.read(spark, path).select("scrape_id", "url", "ts", F.size("products").alias("products_count"))


@register("archive_full", _ARCH, f"""
WITH u AS (SELECT * FROM fx_archive WHERE url NOT IN (SELECT url FROM {_fresh('DESC')} f)
           UNION ALL SELECT * FROM {_fresh('DESC')} f)
SELECT scrape_id, url, ts, {', '.join(f'len({c}) AS n_{c}' for c in archive.LISTS)},
       array_to_string(list_transform(deduplicated_data, lambda x: x.price), '|') AS prices,
       array_to_string(list_transform(scraped_content, lambda x: x.text), '|') AS texts,
       array_to_string(list_transform(chunks, lambda x: x.url || ' ' || x.text), '|') AS chunk_texts,
       array_to_string(list_transform(list_filter(tagged_chunks, lambda x: x.has_price_info), lambda x: x.url), '|') AS priced
FROM u""")
def q_archive_full(spark, sf):
    """A2/A3: all five lists of every scrape, stored and read back."""
    path = export.export_dir(spark, "archive_full")
    archive.write(archive.upsert(fixture(spark, sf, "fx_archive"), fixture(spark, sf, "fx_new_scrapes"), force=True), path)
    return archive.read(spark, path).select(
        "scrape_id", "url", "ts", *[F.size(c).alias(f"n_{c}") for c in archive.LISTS],
        F.array_join(F.col("deduplicated_data.price"), "|").alias("prices"),
        F.array_join(F.col("scraped_content.text"), "|").alias("texts"),
        F.array_join(F.transform("chunks", lambda x: F.concat_ws(" ", x["url"], x["text"])), "|").alias("chunk_texts"),
        F.array_join(F.transform(F.filter("tagged_chunks", lambda x: x["has_price_info"]), lambda x: x["url"]), "|")
        .alias("priced"))


_PCOLS = ("row_id, product_name, price, category, description, source_url, is_plan, plan_features, trial_info, "
          "provider, category_confidence, is_valid_category")


@register("csv_roundtrip", ["fx_products"], f"""
SELECT {', '.join(f"nullif(CAST({c} AS VARCHAR), '') AS {c}" for c in _PCOLS.split(', '))} FROM fx_products""")
def q_csv_roundtrip(spark, sf):
    path = export.export_dir(spark, "csv")
    export.write_csv(fixture(spark, sf, "fx_products"), path)
    return export.read_csv(spark, path)


@register("json_roundtrip", ["fx_products"], f"SELECT {_PCOLS} FROM fx_products")
def q_json_roundtrip(spark, sf):
    p = fixture(spark, sf, "fx_products").withColumn("b64_data", F.base64(F.col("product_name").cast("binary")))
    path = export.export_dir(spark, "json")
    export.write_json(p, path)
    return spark.read.schema(fixture(spark, sf, "fx_products").schema).json(path)


@register("vector_collection", ["fx_tag_answers"], f"""
WITH tg AS ({tags_sql()}),
ch AS (SELECT tg.*, d.text FROM tg JOIN documents d ON d.doc_id = tg.chunk_id),
e AS (SELECT vec_id AS chunk_id, CASE WHEN vec_id % 10 = 0 THEN NULL ELSE embedding END AS embedding FROM embeddings),
j AS (SELECT ch.*, e.embedding FROM ch JOIN e ON ch.chunk_id = e.chunk_id WHERE e.embedding IS NOT NULL)
SELECT CAST(row_number() OVER (ORDER BY chunk_id) - 1 AS VARCHAR) AS id, chunk_id, embedding,
       map(['text', 'url', 'has_product_info', 'has_price_info', 'confidence', 'reasoning'],
           [text, url, CASE WHEN has_product_info THEN 'True' ELSE 'False' END,
            CASE WHEN has_price_info THEN 'True' ELSE 'False' END, CAST(confidence AS VARCHAR), reasoning]) AS metadata
FROM j""")
def q_vector_collection(spark, sf):
    tagged = answers.tags(fixture(spark, sf, "fx_tag_answers"))
    docs = read_table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    chunks = tagged.join(docs, "chunk_id")
    emb = read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.when(F.col("vec_id") % 10 == 0, F.lit(None)).otherwise(F.col("embedding")).alias("embedding"))
    return export.vector_rows(chunks, emb)


@register("binary_catalogue", [], None)
def q_binary_catalogue(spark, sf):
    return export.binary_catalogue(spark, f"{sf.rstrip('/')}/*.parquet")
