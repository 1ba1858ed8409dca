"""Filters, projections and statistics on product and chunk tables (groups F, G)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricesieve import constants as K
from pricesieve.functions.text import lit_array, pystrip
from pricesieve.session import materialize


def _alt(words) -> str:
    # pandas str.contains('|'.join(words)): the words are regexes joined by '|'
    return "|".join(words)


def _is_plan(col: str = "is_plan"):
    return F.lower(F.coalesce(F.col(col), F.lit("false"))) == "true"


# ----------------------------------------------------------------- filters (F)
def filter_urls(products: DataFrame, urls: DataFrame | list) -> DataFrame:
    """keep rows whose source_url is selected (a list, or a one-column table of urls)."""
    if isinstance(urls, list):
        return products.filter(F.col("source_url").isin(urls))
    sel = urls.select(F.col(urls.columns[0]).alias("source_url")).distinct()
    return products.join(sel, "source_url", "left_semi")


def price_flags(products: DataFrame, no_price=K.NO_PRICE_PATTERNS, quote=K.QUOTE_TERMS):
    """Columns shared by F2/F3: the price with the sentinel for nulls and its three tests."""
    price = F.coalesce(F.col("price"), F.lit(K.PRICE_NOT_FOUND))
    no_price_hit = F.lower(price).rlike(_alt(no_price))
    has_digit = price.rlike(r"(?U)\d")
    quote_hit = F.lower(price).rlike(_alt(quote))
    return price, no_price_hit, has_digit, quote_hit


def with_price(products: DataFrame, no_price=K.NO_PRICE_PATTERNS, quote=K.QUOTE_TERMS) -> DataFrame:
    """price (null read as the sentinel) matches no no-price pattern and has a digit
    or a quote term.  The output carries the filled price."""
    price, nph, dig, qh = price_flags(products, no_price, quote)
    return products.withColumn("price", price).filter(~nph & (dig | qh))


def without_price(products: DataFrame, no_price=K.NO_PRICE_PATTERNS, quote=K.QUOTE_TERMS) -> DataFrame:
    """the complement of F2."""
    price, nph, dig, qh = price_flags(products, no_price, quote)
    return products.withColumn("price", price).filter(nph | (~dig & ~qh))


def plans(products: DataFrame) -> DataFrame:
    """subscription plans; is_plan null reads as 'false', case-insensitive."""
    return products.withColumn("is_plan", F.coalesce("is_plan", F.lit("false"))).filter(_is_plan())


def non_plans(products: DataFrame) -> DataFrame:
    """regular products."""
    return products.withColumn("is_plan", F.coalesce("is_plan", F.lit("false"))).filter(~_is_plan())


def filter_category(products: DataFrame, categories: list[str]) -> DataFrame:
    """category membership; an empty selection keeps everything."""
    return products if not categories else products.filter(F.col("category").isin(categories))


def price_sentinel(products: DataFrame, with_prices: bool = True) -> DataFrame:
    """equality with the sentinel.  A null price is 'not equal' (kept as with price)."""
    eq = F.col("price").eqNullSafe(F.lit(K.PRICE_NOT_FOUND))
    return products.filter(~eq if with_prices else eq)


def chunk_filter(tagged: DataFrame, threshold: float = 50.0) -> DataFrame:
    """(product or price flag) and confidence >= threshold; missing flags false, confidence 0."""
    flag = F.coalesce("has_product_info", F.lit(False)) | F.coalesce("has_price_info", F.lit(False))
    return tagged.filter(flag & (F.coalesce("confidence", F.lit(0.0)) >= threshold))


def numeric_price(items: DataFrame) -> DataFrame:
    """F8: price that parses as a number and is > 0."""
    return items.filter(F.col("price").try_cast("double") > 0)


def _hidden(c: str):
    s = F.col(c)
    return F.when(s.isNull() | F.lower(s).isin(K.HIDDEN_FIELD_VALUES), F.lit(None)).otherwise(s)


def plan_details(products: DataFrame) -> DataFrame:
    """plan rows with blank / 'none' / 'nan' fields hidden (null)."""
    p = products.filter(F.lower(F.col("is_plan")) == "true")
    return p.select(
        "row_id", "product_name", "price",
        _hidden("trial_info").alias("trial_info"),
        _hidden("description").alias("description"),
        _hidden("plan_features").alias("plan_features"),
    )


def plan_features(products: DataFrame) -> DataFrame:
    """plan features split on ',', stripped, blanks dropped; one row per feature."""
    p = plan_details(products).filter(F.col("plan_features").isNotNull())
    out = p.select("row_id", F.posexplode(F.split("plan_features", ",")).alias("feature_no", "raw"))
    return out.select("row_id", "feature_no", pystrip("raw").alias("feature")).filter(F.col("feature") != "")


def categories(products: DataFrame) -> DataFrame:
    """sorted distinct categories (nulls left out)."""
    return products.select("category").where(F.col("category").isNotNull()).distinct().orderBy("category")


def source_urls(products: DataFrame) -> DataFrame:
    """Distinct source URLs, with their count (the URL filter is offered when > 1)."""
    return products.select("source_url").distinct()


def confidence_band(products: DataFrame) -> DataFrame:
    """band label of category_confidence and the plan highlight flag."""
    c = F.col("category_confidence")
    band = F.when(c >= K.HIGH_CONFIDENCE, "high").when(c >= K.MEDIUM_CONFIDENCE, "medium").otherwise("low")
    return products.select("row_id", band.alias("band"), (F.lower("is_plan") == "true").alias("highlight"))


def labels_text(products: DataFrame) -> DataFrame:
    """'name (category)' with 'Unknown' / 'Uncategorized' for missing values."""
    lab = F.concat(
        F.coalesce("product_name", F.lit(K.UNKNOWN)), F.lit(" ("),
        F.coalesce("category", F.lit(K.UNCATEGORIZED)), F.lit(")"),
    )
    return products.select("row_id", lab.alias("label"))


# -------------------------------------------------------------- aggregates (G)
def totals(products: DataFrame) -> DataFrame:
    """Totals; null price counts as 'with price' (it is not the sentinel)."""
    sentinel = F.col("price").eqNullSafe(F.lit(K.PRICE_NOT_FOUND))
    return products.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(~sentinel).alias("with_price"),
        F.count_if(sentinel).alias("without_price"),
        F.count_if(F.lower("is_plan") == "true").alias("plans"),
        F.count_distinct("source_url").alias("urls"),
    )


def category_counts(products: DataFrame, null_label: str | None = None) -> DataFrame:
    """Products per category, descending.  Nulls are skipped, or counted under
    ``null_label`` when given."""
    cat = F.col("category") if null_label is None else F.coalesce("category", F.lit(null_label))
    out = products.select(cat.alias("category"))
    if null_label is None:
        out = out.filter(F.col("category").isNotNull())
    return out.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def _rate(n, total):
    return F.when(total > 0, n / total)


def confidence_stats(products: DataFrame) -> DataFrame:
    """High / medium / low confidence and valid / invalid counts with rates."""
    c = F.col("category_confidence")
    agg = products.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(c >= K.HIGH_CONFIDENCE).alias("high"),
        F.count_if((c >= K.MEDIUM_CONFIDENCE) & (c < K.HIGH_CONFIDENCE)).alias("medium"),
        F.count_if(c < K.MEDIUM_CONFIDENCE).alias("low"),
        F.count_if(F.col("is_valid_category")).alias("valid"),
        F.count_if(~F.col("is_valid_category")).alias("invalid"),
    )
    t = F.col("total")
    return agg.select(
        "total", "high", "medium", "low", "valid", "invalid",
        *[_rate(F.col(k), t).alias(f"{k}_rate") for k in ("high", "medium", "low", "valid", "invalid")],
    )


def price_share(products: DataFrame) -> DataFrame:
    """With / without price counts and their percentage, one decimal."""
    t = totals(products)
    n = F.col("with_price") + F.col("without_price")
    return t.select(
        "with_price", "without_price",
        F.when(n > 0, F.round(100.0 * F.col("with_price") / n, 1)).alias("with_pct"),
        F.when(n > 0, F.round(100.0 * F.col("without_price") / n, 1)).alias("without_pct"),
    )


def tag_distribution(tagged: DataFrame) -> DataFrame:
    """Chunks by tag pair, all four labels present (zero when empty)."""
    p = F.coalesce("has_product_info", F.lit(False))
    q = F.coalesce("has_price_info", F.lit(False))
    lab = F.when(p & q, K.TAG_LABELS[0]).when(p, K.TAG_LABELS[1]).when(q, K.TAG_LABELS[2]).otherwise(K.TAG_LABELS[3])
    counts = tagged.groupBy(lab.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    spark = tagged.sparkSession
    labels = spark.createDataFrame([(i, s) for i, s in enumerate(K.TAG_LABELS)], "pos int, label string")
    return (
        F.broadcast(labels).join(counts, "label", "left")  # the four fixed labels
        .select("pos", "label", F.coalesce("n", F.lit(0)).alias("n"))
    )


def confidence_hist(tagged: DataFrame, bins: int = K.CONFIDENCE_BINS, lo: float = K.CONFIDENCE_RANGE[0],
                    hi: float = K.CONFIDENCE_RANGE[1]) -> DataFrame:
    """Equal-width histogram over [lo, hi], last bin closed, outside values ignored;
    a missing confidence counts as 0."""
    c = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col("c") - lo) / width), F.lit(bins - 1)).cast("int")
    counts = (
        tagged.select(c.alias("c")).filter((F.col("c") >= lo) & (F.col("c") <= hi))
        .groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )
    spark = tagged.sparkSession
    edges = spark.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(lo) + F.col("id") * width).alias("lo"),
        (F.lit(lo) + (F.col("id") + 1) * width).alias("hi"),
    )
    # ``bins`` rows (a parameter): a broadcast of a proven size
    return F.broadcast(edges).join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def running_totals(df: DataFrame, order: str, sums: dict, lead=None) -> DataFrame:
    """Running sums over a global order (``lead`` first, if given, then ``order``) without a
    window over all rows.

    The rows are range-partitioned on the order and stored with the number of their range, so the
    ranges are even however sparse the values are.  Each range adds the totals of the ranges
    before it to its own window.  The totals, one row for each of the ``spark.sql.shuffle.partitions``
    ranges, are added up on the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["_lead", order]
    base = df.withColumn("_lead", F.lit(0) if lead is None else lead).repartitionByRange(n, *keys)
    base = materialize(base.withColumn("_range", F.spark_partition_id()))
    totals = base.groupBy("_range").agg(*[F.sum(e).alias(f"_o_{k}") for k, e in sums.items()])
    before, rows = [0] * len(sums), []
    for r in sorted(totals.collect()):
        rows.append((r[0], *before))
        before = [x + (y or 0) for x, y in zip(before, r[1:])]
    offsets = F.broadcast(spark.createDataFrame(rows, totals.schema))  # a row for each range
    w = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = base.join(offsets, "_range")
    for k, e in sums.items():
        out = out.withColumn(k, F.col(f"_o_{k}") + F.sum(e).over(w))
    return out.drop("_range", "_lead", *[f"_o_{k}" for k in sums])


def progress(products: DataFrame, processed_chunks: DataFrame) -> DataFrame:
    """After each processed chunk (in chunk_id order), running counts of chunks,
    products, with price and without price.  A chunk without products counts too."""
    per_chunk = products.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(~F.col("price").eqNullSafe(F.lit(K.PRICE_NOT_FOUND))).alias("priced"),
        F.count_if(F.col("price").eqNullSafe(F.lit(K.PRICE_NOT_FOUND))).alias("unpriced"),
    )
    chunks = processed_chunks.select("chunk_id").distinct().join(per_chunk, "chunk_id", "left").fillna(0)
    out = running_totals(
        chunks, "chunk_id",
        {"processed": F.lit(1), "products_found": F.col("found"),
         "with_price": F.col("priced"), "without_price": F.col("unpriced")},
    )
    return out.select("chunk_id", "processed", "products_found", "with_price", "without_price")


def items_per_doc(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """Item count per document."""
    return items.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"))
