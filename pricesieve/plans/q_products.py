"""Registered queries for product filters, statistics, edits and selection (F, G, K, E14-E16)."""
from __future__ import annotations

from pyspark.sql import functions as F

from pricesieve.operators import edits, explore
from pricesieve.plans.fixtures import fixture
from pricesieve.plans.registry import register
from pricesieve.plans.sqlfrag import strip

P = ["fx_products"]
NO_PRICE = "price not found|not found|not specified|n/a|unknown"
QUOTE = "contact|quote|custom|call|inquiry|request|enterprise|estimate|consultation|quotation"
COLS = ("row_id, product_name, price, category, description, source_url, is_plan, plan_features, "
        "trial_info, provider, category_confidence, is_valid_category")


def _p(spark, sf):
    return fixture(spark, sf, "fx_products")


def _except(cols: str, name: str) -> str:
    return ", ".join(c for c in cols.split(", ") if c != name)


@register("filter_urls", P, """
SELECT * FROM fx_products WHERE source_url IN
  (SELECT DISTINCT source_url FROM fx_products WHERE category = 'SMALL' AND is_plan = 'true')""")
def q_filter_urls(spark, sf):
    # the selected URLs: those that list a small plan
    p = _p(spark, sf)
    chosen = p.filter((F.col("category") == "SMALL") & (F.col("is_plan") == "true"))
    return explore.filter_urls(p, chosen.select("source_url"))


_PRICE = "coalesce(price, 'Price not found')"


@register("with_price", P, f"""
SELECT {_except(COLS, 'price')}, {_PRICE} AS price FROM fx_products
WHERE NOT regexp_matches(lower({_PRICE}), '{NO_PRICE}')
  AND (regexp_matches({_PRICE}, '\\d') OR regexp_matches(lower({_PRICE}), '{QUOTE}'))""")
def q_with_price(spark, sf):
    return explore.with_price(_p(spark, sf))


@register("without_price", P, f"""
SELECT {_except(COLS, 'price')}, {_PRICE} AS price FROM fx_products
WHERE regexp_matches(lower({_PRICE}), '{NO_PRICE}')
   OR (NOT regexp_matches({_PRICE}, '\\d') AND NOT regexp_matches(lower({_PRICE}), '{QUOTE}'))""")
def q_without_price(spark, sf):
    return explore.without_price(_p(spark, sf))


@register("plans", P, f"""
SELECT {_except(COLS, 'is_plan')}, coalesce(is_plan, 'false') AS is_plan FROM fx_products
WHERE lower(coalesce(is_plan, 'false')) = 'true'""")
def q_plans(spark, sf):
    return explore.plans(_p(spark, sf))


@register("non_plans", P, f"""
SELECT {_except(COLS, 'is_plan')}, coalesce(is_plan, 'false') AS is_plan FROM fx_products
WHERE lower(coalesce(is_plan, 'false')) <> 'true'""")
def q_non_plans(spark, sf):
    return explore.non_plans(_p(spark, sf))


@register("filter_category", P, "SELECT * FROM fx_products WHERE category IN ('SMALL', 'LARGE', 'Uncategorized')")
def q_filter_category(spark, sf):
    return explore.filter_category(_p(spark, sf), ["SMALL", "LARGE", "Uncategorized"])


@register("price_sentinel", P, "SELECT * FROM fx_products WHERE price IS DISTINCT FROM 'Price not found'")
def q_price_sentinel(spark, sf):
    return explore.price_sentinel(_p(spark, sf), with_prices=True)


@register("chunk_filter", ["fx_tagged"], """
SELECT * FROM fx_tagged
WHERE (coalesce(has_product_info, false) OR coalesce(has_price_info, false))
  AND coalesce(confidence, 0.0) >= 50.0""")
def q_chunk_filter(spark, sf):
    return explore.chunk_filter(fixture(spark, sf, "fx_tagged"), 50.0)


@register("numeric_price", ["fx_listing_text"], """
SELECT * FROM (
  SELECT doc_id, i - 1 AS line_no,
         regexp_extract(parts[i], '(\\d+[.]\\d{2})', 1) AS price
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM fx_listing_text) s,
       generate_series(1, len(parts)) AS g(i)) x
WHERE TRY_CAST(price AS DOUBLE) > 0""")
def q_numeric_price(spark, sf):
    from pricesieve.operators.text import lines
    ln = lines(fixture(spark, sf, "fx_listing_text"), keep_blank=True)
    items = ln.select("doc_id", "line_no", F.regexp_extract("line", r"(\d+[.]\d{2})", 1).alias("price"))
    return explore.numeric_price(items)


def _hidden(c):
    return f"CASE WHEN {c} IS NULL OR lower({c}) IN ('none', 'nan', '') THEN NULL ELSE {c} END AS {c}"


_PLAN_DETAILS = f"""SELECT row_id, product_name, price, {_hidden('trial_info')}, {_hidden('description')},
       {_hidden('plan_features')} FROM fx_products WHERE lower(is_plan) = 'true'"""


@register("plan_details", P, _PLAN_DETAILS)
def q_plan_details(spark, sf):
    return explore.plan_details(_p(spark, sf))


@register("plan_features", P, f"""
SELECT row_id, feature_no, feature FROM (
  SELECT row_id, i - 1 AS feature_no, regexp_replace(parts[i], '^\\s+|\\s+$', '', 'g') AS feature
  FROM (SELECT row_id, string_split(plan_features, ',') AS parts FROM ({_PLAN_DETAILS}) d
        WHERE plan_features IS NOT NULL) s,
       generate_series(1, len(parts)) AS g(i)) x
WHERE feature <> ''""")
def q_plan_features(spark, sf):
    return explore.plan_features(_p(spark, sf))


@register("categories", P, "SELECT DISTINCT category FROM fx_products WHERE category IS NOT NULL")
def q_categories(spark, sf):
    return explore.categories(_p(spark, sf))


@register("confidence_band", P, """
SELECT row_id,
       CASE WHEN category_confidence >= 0.7 THEN 'high' WHEN category_confidence >= 0.4 THEN 'medium'
            ELSE 'low' END AS band,
       lower(is_plan) = 'true' AS highlight
FROM fx_products""")
def q_confidence_band(spark, sf):
    return explore.confidence_band(_p(spark, sf))


@register("labels_text", P, """
SELECT row_id, coalesce(product_name, 'Unknown') || ' (' || coalesce(category, 'Uncategorized') || ')' AS label
FROM fx_products""")
def q_labels_text(spark, sf):
    return explore.labels_text(_p(spark, sf))


_TOTALS = """SELECT count(*) AS total_products,
       count_if(price IS DISTINCT FROM 'Price not found') AS with_price,
       count_if(price IS NOT DISTINCT FROM 'Price not found') AS without_price,
       count_if(lower(is_plan) = 'true') AS plans,
       count(DISTINCT source_url) AS urls
FROM fx_products"""


@register("totals", P, _TOTALS)
def q_totals(spark, sf):
    return explore.totals(_p(spark, sf))


@register("category_counts", P, """
SELECT category, count(*) AS n FROM fx_products WHERE category IS NOT NULL GROUP BY category""")
def q_category_counts(spark, sf):
    return explore.category_counts(_p(spark, sf))


@register("confidence_stats", P, """
WITH a AS (
  SELECT count(*) AS total,
         count_if(category_confidence >= 0.7) AS high,
         count_if(category_confidence >= 0.4 AND category_confidence < 0.7) AS medium,
         count_if(category_confidence < 0.4) AS low,
         count_if(is_valid_category) AS valid,
         count_if(NOT is_valid_category) AS invalid
  FROM fx_products)
SELECT total, high, medium, low, valid, invalid,
       CASE WHEN total > 0 THEN high / total END AS high_rate,
       CASE WHEN total > 0 THEN medium / total END AS medium_rate,
       CASE WHEN total > 0 THEN low / total END AS low_rate,
       CASE WHEN total > 0 THEN valid / total END AS valid_rate,
       CASE WHEN total > 0 THEN invalid / total END AS invalid_rate
FROM a""")
def q_confidence_stats(spark, sf):
    return explore.confidence_stats(_p(spark, sf))


@register("price_share", P, f"""
WITH t AS ({_TOTALS})
SELECT with_price, without_price,
       CASE WHEN with_price + without_price > 0
            THEN round(100.0 * with_price / (with_price + without_price), 1) END AS with_pct,
       CASE WHEN with_price + without_price > 0
            THEN round(100.0 * without_price / (with_price + without_price), 1) END AS without_pct
FROM t""")
def q_price_share(spark, sf):
    return explore.price_share(_p(spark, sf))


@register("tag_distribution", ["fx_tagged"], """
WITH lab(pos, label) AS (VALUES (0, 'Product & Price'), (1, 'Product Only'), (2, 'Price Only'), (3, 'Neither')),
c AS (
  SELECT CASE WHEN coalesce(has_product_info, false) AND coalesce(has_price_info, false) THEN 'Product & Price'
              WHEN coalesce(has_product_info, false) THEN 'Product Only'
              WHEN coalesce(has_price_info, false) THEN 'Price Only'
              ELSE 'Neither' END AS label, count(*) AS n
  FROM fx_tagged GROUP BY 1)
SELECT pos, lab.label, coalesce(n, 0) AS n FROM lab LEFT JOIN c ON lab.label = c.label""")
def q_tag_distribution(spark, sf):
    return explore.tag_distribution(fixture(spark, sf, "fx_tagged"))


@register("confidence_hist", ["fx_tagged"], """
WITH v AS (SELECT coalesce(confidence, 0.0) AS c FROM fx_tagged),
c AS (SELECT CAST(least(floor(c / 10.0), 9) AS INTEGER) AS bin, count(*) AS n
      FROM v WHERE c >= 0 AND c <= 100 GROUP BY 1),
e AS (SELECT CAST(i AS INTEGER) AS bin, 0.0 + i * 10.0 AS lo, 0.0 + (i + 1) * 10.0 AS hi FROM range(10) r(i))
SELECT e.bin, lo, hi, coalesce(n, 0) AS n FROM e LEFT JOIN c ON e.bin = c.bin""")
def q_confidence_hist(spark, sf):
    return explore.confidence_hist(fixture(spark, sf, "fx_tagged"))


@register("progress", ["fx_products", "fx_tagged"], """
WITH chunks AS (
  SELECT DISTINCT chunk_id FROM fx_tagged
  WHERE (coalesce(has_product_info, false) OR coalesce(has_price_info, false))
    AND coalesce(confidence, 0.0) >= 50.0),
prods AS (SELECT CAST(floor(row_id / 2) AS BIGINT) AS chunk_id, price FROM fx_products),
per AS (
  SELECT c.chunk_id, count(p.chunk_id) AS found,
         count_if(p.chunk_id IS NOT NULL AND p.price IS DISTINCT FROM 'Price not found') AS priced,
         count_if(p.chunk_id IS NOT NULL AND p.price IS NOT DISTINCT FROM 'Price not found') AS unpriced
  FROM chunks c LEFT JOIN prods p ON c.chunk_id = p.chunk_id GROUP BY c.chunk_id)
SELECT chunk_id,
       count(*) OVER w AS processed,
       CAST(sum(found) OVER w AS BIGINT) AS products_found,
       CAST(sum(priced) OVER w AS BIGINT) AS with_price,
       CAST(sum(unpriced) OVER w AS BIGINT) AS without_price
FROM per WINDOW w AS (ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_progress(spark, sf):
    p = _p(spark, sf).select(F.floor(F.col("row_id") / 2).alias("chunk_id"), "price")
    chunks = explore.chunk_filter(fixture(spark, sf, "fx_tagged"), 50.0)
    return explore.progress(p, chunks)


@register("items_per_doc", ["fx_listing_text"], """
SELECT doc_id, count(*) AS n_items FROM (
  SELECT doc_id, parts[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM fx_listing_text) s,
       generate_series(1, len(parts)) AS g(i)) x
WHERE regexp_matches(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^(.*?)(\\d{1,2}\\.\\d{2})$')
  AND length(regexp_replace(regexp_replace(regexp_extract(regexp_replace(line, '^\\s+|\\s+$', '', 'g'),
        '^(.*?)(\\d{1,2}\\.\\d{2})$', 1), '^\\s+|\\s+$', '', 'g'), '[\\s.]+$', '')) > 3
GROUP BY doc_id""")
def q_items_per_doc(spark, sf):
    from pricesieve.operators.menu import menu_line_end
    return explore.items_per_doc(menu_line_end(fixture(spark, sf, "fx_listing_text")))


# ------------------------------------------------------------------- edits (K)
E = ["fx_products", "fx_edits"]


@register("edit_insert", E, """
SELECT row_id, product_name, price, category, description, source_url, is_plan, plan_features, trial_info,
       provider, category_confidence, is_valid_category,
       CAST(NULL AS BOOLEAN) AS is_manually_added, CAST(NULL AS VARCHAR) AS original_category
FROM fx_products
UNION ALL
SELECT row_id, new_name, CASE WHEN coalesce(new_price, '') <> '' THEN new_price ELSE 'Price not found' END,
       new_category,
       CASE WHEN coalesce(new_description, '') <> '' THEN new_description ELSE 'No description available' END,
       source_url, NULL, NULL, NULL, NULL, 0.9, true, true, new_category
FROM fx_edits
WHERE op = 'insert' AND coalesce(new_name <> '', false) AND coalesce(new_category <> '', false)""")
def q_edit_insert(spark, sf):
    return edits.edit_insert(_p(spark, sf), fixture(spark, sf, "fx_edits"))


_KEYJOIN = """p.product_name IS NOT DISTINCT FROM k.product_name AND p.category IS NOT DISTINCT FROM k.category
      AND p.source_url IS NOT DISTINCT FROM k.source_url"""


@register("edit_update", E, f"""
WITH k AS (
  SELECT e.edit_id, p.product_name, p.category, p.source_url, e.new_name, e.new_category, e.new_price,
         e.new_description
  FROM fx_edits e JOIN fx_products p ON p.row_id = e.row_id WHERE e.op = 'update'),
r AS (
  SELECT p.row_id AS target_id, k.* FROM fx_products p JOIN k ON {_KEYJOIN}),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY edit_id DESC) AS rn FROM r) x
      WHERE rn = 1)
SELECT p.row_id,
       CASE WHEN l.target_id IS NOT NULL THEN l.new_name ELSE p.product_name END AS product_name,
       CASE WHEN l.target_id IS NOT NULL THEN l.new_price ELSE p.price END AS price,
       CASE WHEN l.target_id IS NOT NULL THEN l.new_category ELSE p.category END AS category,
       CASE WHEN l.target_id IS NOT NULL THEN l.new_description ELSE p.description END AS description,
       p.source_url, p.is_plan, p.plan_features, p.trial_info, p.provider,
       CASE WHEN l.target_id IS NOT NULL THEN 0.9 ELSE p.category_confidence END AS category_confidence,
       CASE WHEN l.target_id IS NOT NULL THEN true ELSE p.is_valid_category END AS is_valid_category,
       CASE WHEN l.target_id IS NOT NULL THEN true END AS is_manually_edited,
       CASE WHEN l.target_id IS NOT NULL THEN l.new_category END AS original_category
FROM fx_products p LEFT JOIN l ON p.row_id = l.target_id""")
def q_edit_update(spark, sf):
    return edits.edit_update(_p(spark, sf), fixture(spark, sf, "fx_edits"))


@register("edit_delete", E, f"""
WITH k AS (
  SELECT p.product_name, p.category, p.source_url
  FROM fx_edits e JOIN fx_products p ON p.row_id = e.row_id WHERE e.op = 'delete')
SELECT * FROM fx_products p WHERE NOT EXISTS (SELECT 1 FROM k WHERE {_KEYJOIN})""")
def q_edit_delete(spark, sf):
    return edits.edit_delete(_p(spark, sf), fixture(spark, sf, "fx_edits"))


_DUP = f"""SELECT *,
       row_number() OVER (PARTITION BY lower({strip('product_name')}) || '|' ||
            CASE WHEN lower({strip('price')}) = 'free' THEN '$0' ELSE lower({strip('price')}) END ORDER BY row_id) > 1
         AS dup_exact,
       provider IS NOT NULL AND row_number() OVER (PARTITION BY provider ORDER BY row_id) > 1 AS dup_provider
FROM fx_products"""


@register("dup_exact", P, f"SELECT * EXCLUDE (dup_provider) FROM ({_DUP}) d")
def q_dup_exact(spark, sf):
    return edits.dup_exact(_p(spark, sf))


@register("dup_provider", P, f"SELECT * EXCLUDE (dup_exact) FROM ({_DUP}) d")
def q_dup_provider(spark, sf):
    return edits.dup_provider(_p(spark, sf))


@register("select_export", P, f"SELECT {COLS} FROM ({_DUP}) d WHERE NOT (dup_exact OR dup_provider)")
def q_select_export(spark, sf):
    return edits.select_export(_p(spark, sf))
