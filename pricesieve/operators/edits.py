"""Manual corrections and export selection on product tables (groups K, E14-E16).

An edit batch is a table ``(edit_id, op, row_id, new_name, new_category, new_price,
new_description)`` with ``op`` in insert / update / delete.  All edits of a batch see
the input table (they are applied together); when several updates reach one row the
one with the highest ``edit_id`` wins.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricesieve import constants as K
from pricesieve.functions.text import pystrip

KEY = ("product_name", "category", "source_url")


def _null_safe_key_join(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    cond = None
    for c in KEY:
        e = left[c].eqNullSafe(right[f"k_{c}"])
        cond = e if cond is None else cond & e
    return left.join(right, cond, how)


def edit_insert(products: DataFrame, edits: DataFrame) -> DataFrame:
    """K1: add products; name and category are required, price and description get defaults."""
    ins = edits.filter(
        (F.col("op") == "insert")
        & F.coalesce(F.col("new_name") != "", F.lit(False))
        & F.coalesce(F.col("new_category") != "", F.lit(False))
    )
    new = ins.select(
        "row_id",
        F.col("new_name").alias("product_name"),
        F.col("new_category").alias("category"),
        F.when(F.coalesce(F.col("new_price"), F.lit("")) != "", F.col("new_price"))
        .otherwise(F.lit(K.PRICE_NOT_FOUND)).alias("price"),
        F.when(F.coalesce(F.col("new_description"), F.lit("")) != "", F.col("new_description"))
        .otherwise(F.lit(K.NO_DESCRIPTION)).alias("description"),
        F.col("source_url"),
        F.lit(True).alias("is_manually_added"),
        F.col("new_category").alias("original_category"),
        F.lit(K.MANUAL_CONFIDENCE).alias("category_confidence"),
        F.lit(True).alias("is_valid_category"),
    )
    return products.unionByName(new, allowMissingColumns=True)


def _last_edits(products: DataFrame, edits: DataFrame, op: str, carry: bool) -> DataFrame:
    """The last edit (highest edit_id) of each edited row or, with ``carry``, of each
    (name, category, url) of an edited row, nulls equal: one row per key, however many
    edits share it."""
    new_cols = [c for c in edits.columns if c.startswith("new_")]
    e = edits.filter(F.col("op") == op).select("edit_id", "row_id", *new_cols)
    last = F.max_by(F.struct(*new_cols), "edit_id").alias("new")
    if not carry:
        return e.groupBy("row_id").agg(last)
    keys = products.select("row_id", *[F.col(c).alias(f"k_{c}") for c in KEY])
    return e.join(keys, "row_id").groupBy(*[f"k_{c}" for c in KEY]).agg(last)


def _reach(products: DataFrame, last: DataFrame, carry: bool, how: str) -> DataFrame:
    return _null_safe_key_join(products, last, how) if carry else products.join(last, "row_id", how)


def edit_update(products: DataFrame, edits: DataFrame, carry: bool = True) -> DataFrame:
    """K2: set name, category, price, description; mark edited with confidence 0.9."""
    last = _last_edits(products, edits, "update", carry).select("*", "new.*", F.lit(True).alias("_hit")).drop("new")
    j = _reach(products, last, carry, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    cols = {
        "product_name": F.when(hit, F.col("new_name")).otherwise(F.col("product_name")),
        "category": F.when(hit, F.col("new_category")).otherwise(F.col("category")),
        "price": F.when(hit, F.col("new_price")).otherwise(F.col("price")),
        "description": F.when(hit, F.col("new_description")).otherwise(F.col("description")),
        "is_manually_edited": F.when(hit, F.lit(True)),
        "original_category": F.when(hit, F.col("new_category")),
        "category_confidence": F.when(hit, F.lit(K.MANUAL_CONFIDENCE)).otherwise(F.col("category_confidence")),
        "is_valid_category": F.when(hit, F.lit(True)).otherwise(F.col("is_valid_category")),
    }
    out = j
    for c, e in cols.items():
        out = out.withColumn(c, e)
    return out.drop("_hit", *[c for c in last.columns if c.startswith(("new_", "k_"))])


def edit_delete(products: DataFrame, edits: DataFrame, carry: bool = True) -> DataFrame:
    """K3: remove the row and, with ``carry``, all rows with an equal key."""
    return _reach(products, _last_edits(products, edits, "delete", carry), carry, "left_anti")


# ------------------------------------------------------------ selection (K4)
def dup_exact(products: DataFrame) -> DataFrame:
    """Key lower/strip(name) | lower/strip(price) with 'free' read as '$0'; the first
    row (row_id order) of each key is kept.  A null name or price makes the key null,
    and null keys count as equal to each other."""
    price = F.lower(pystrip("price"))
    price = F.when(price == "free", F.lit("$0")).otherwise(price)
    keyed = products.withColumn("_key", F.concat(F.lower(pystrip("product_name")), F.lit("|"), price))
    first = keyed.groupBy("_key").agg(F.min("row_id").alias("_first")).withColumnRenamed("_key", "_k")
    out = keyed.join(first, F.col("_key").eqNullSafe(F.col("_k")))
    return out.withColumn("dup_exact", F.col("row_id") > F.col("_first")).drop("_key", "_k", "_first")


def dup_provider(products: DataFrame) -> DataFrame:
    """Per non-null provider (the empty string included) all but the first row."""
    first = (products.where("provider IS NOT NULL").groupBy(F.col("provider").alias("_p"))
             .agg(F.min("row_id").alias("_first")))
    out = products.join(first, F.col("provider") == F.col("_p"), "left")
    return out.withColumn("dup_provider", F.coalesce(F.col("row_id") > F.col("_first"), F.lit(False))).drop("_p", "_first")


def select_export(products: DataFrame) -> DataFrame:
    """K4: everything selected, then E14 and E15 unselect; the selected rows without the flag."""
    flagged = dup_provider(dup_exact(products))
    sel = flagged.withColumn("selected", ~(F.col("dup_exact") | F.col("dup_provider")))
    return sel.filter("selected").drop("selected", "dup_exact", "dup_provider")


def dedup_stats(original: DataFrame, deduplicated: DataFrame) -> DataFrame:
    """Original and unique counts, reduction and its percentage (one pass over both
    inputs, no join)."""
    both = original.select(F.lit(1).alias("o"), F.lit(0).alias("u")).unionByName(
        deduplicated.select(F.lit(0).alias("o"), F.lit(1).alias("u")))
    out = both.agg(F.sum("o").cast("long").alias("original"), F.sum("u").cast("long").alias("unique"))
    out = out.select(F.coalesce("original", F.lit(0)).alias("original"), F.coalesce("unique", F.lit(0)).alias("unique"))
    red = F.col("original") - F.col("unique")
    return out.select(
        "original", "unique", red.alias("reduction"),
        F.when(F.col("original") > 0, F.round(red / F.col("original") * 100, 1)).otherwise(F.lit(0.0)).alias("reduction_pct"),
    )
