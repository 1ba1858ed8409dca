"""Stored model answers: unfencing, tag and product parsing, category score and relabel
(group D21-D27)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricesieve import constants as K
from pricesieve.functions.text import pystrip

FENCE = "```"


def unfence(c: Column) -> Column:
    """Text between '```json' and the next fence, else between the first two fences;
    stripped.  Answers without a fence are only stripped."""
    t = pystrip(c)
    inner = (
        F.when(t.contains(FENCE + "json"), F.split_part(F.split_part(t, F.lit(FENCE + "json"), F.lit(2)), F.lit(FENCE), F.lit(1)))
        .when(t.contains(FENCE), F.split_part(t, F.lit(FENCE), F.lit(2)))
        .otherwise(t)
    )
    return pystrip(inner)


TAG_SCHEMA = "has_product_info boolean, has_price_info boolean, confidence double, reasoning string"


def tags(answers: DataFrame, response: str = "response") -> DataFrame:
    """Tag answers; missing keys get false / false / 0 / 'No reasoning provided'; an
    answer that is not a JSON object gets the failure row."""
    j = unfence(F.col(response))
    parsed = F.from_json(j, TAG_SCHEMA)
    ok = F.try_parse_json(j).isNotNull() & j.startswith("{")
    d = answers.withColumn("_ok", ok).withColumn("_t", parsed)
    return d.select(
        *[c for c in answers.columns if c != response],
        F.when(F.col("_ok"), F.coalesce("_t.has_product_info", F.lit(False))).otherwise(False).alias("has_product_info"),
        F.when(F.col("_ok"), F.coalesce("_t.has_price_info", F.lit(False))).otherwise(False).alias("has_price_info"),
        F.when(F.col("_ok"), F.coalesce("_t.confidence", F.lit(0.0))).otherwise(0.0).alias("confidence"),
        F.when(F.col("_ok"), F.coalesce("_t.reasoning", F.lit(K.NO_REASONING)))
        .otherwise(F.lit(K.TAG_PARSE_FAILED)).alias("reasoning"),
    )


ITEM_SCHEMA = "array<struct<" + ", ".join(f"{k}: string" for k, _ in K.PRODUCT_DEFAULTS) + ">>"


def answer_items(answers: DataFrame, response: str = "response") -> DataFrame:
    """Product answers: an array is kept, a lone object is one item, anything else
    gives none; missing fields get the defaults; the source URL is the chunk's; a price
    containing 'free' becomes '$0' with original_price 'Free'."""
    j = unfence(F.col(response))
    items = F.from_json(j, ITEM_SCHEMA)
    d = answers.select("chunk_id", "url", "text", F.posexplode(items).alias("item_no", "it"))
    cols = [F.coalesce(F.col(f"it.{k}"), F.lit(v)).alias(k) for k, v in K.PRODUCT_DEFAULTS]
    d = d.select("chunk_id", "item_no", "text", F.col("url").alias("source_url"), *cols)
    free = F.lower("price").contains("free")
    return d.withColumn("original_price", F.when(free, F.lit(K.FREE_ORIGINAL))) \
            .withColumn("price", F.when(free, F.lit(K.FREE_PRICE)).otherwise(F.col("price")))


# ------------------------------------------------------------ category score
def _find_context(text: Column, target: Column, window: int = K.CONTEXT_WINDOW) -> Column:
    pos = F.instr(text, target) - 1
    start = F.greatest(pos - window, F.lit(0))
    end = F.least(F.length(text), pos + F.length(target) + window)
    return F.when(pos < 0, F.lit("")).otherwise(F.substring(text, start + 1, end - start))


def category_suggestions(tl: Column) -> Column:
    """Heading texts after each mark (cut at '<', stripped, first 50 characters, kept
    when 4-49 long), then the groups of four patterns; an item is added unless its raw
    text is already listed; the first three."""
    heads = []
    for mark in K.HEADING_MARKS:
        parts = F.split(tl, _re_quote(mark))
        cand = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
                           lambda p: F.substring(pystrip(F.split_part(p, F.lit("<"), F.lit(1))), 1, 50))
        cand = F.filter(cand, lambda h: (F.length(h) > 3) & (F.length(h) < 50))
        heads.append(F.transform(cand, lambda h: F.struct(h.alias("raw"), h.alias("val"))))
    regs = [
        F.transform(F.filter(F.regexp_extract_all(tl, F.lit(p), 1), lambda m: m != ""),
                    lambda m: F.struct(m.alias("raw"), pystrip(m).alias("val")))
        for p in K.SUGGESTION_PATTERNS
    ]
    allc = F.concat(*heads, *regs)
    empty = F.array().cast("array<string>")
    acc = F.aggregate(allc, empty, lambda a, x: F.when(F.array_contains(a, x["raw"]), a).otherwise(F.concat(a, F.array(x["val"]))))
    return F.slice(acc, 1, K.MAX_SUGGESTIONS)


def _re_quote(s: str) -> str:
    import re
    return re.escape(s)


def category_score(df: DataFrame, category: str = "category", text: str = "text",
                   first_indicator_only: bool = True) -> DataFrame:
    """Confidence, validity and suggestions of a category for a text (rules in order:
    empty/uncategorized, site section, direct occurrence, word overlap, domain keywords;
    suggestions below 0.5).  Only the first context indicator is tested, as in the
    original loop, unless ``first_indicator_only`` is off: then any of them counts."""
    cl = F.lower(F.col(category))
    tl = F.lower(F.col(text))
    d = df.withColumn("_cl", cl).withColumn("_tl", tl)
    cl, tl = F.col("_cl"), F.col("_tl")
    direct = F.instr(tl, cl) > 0
    ctx = _find_context(tl, cl)
    words = F.filter(F.split(cl, r"(?U)[\s\x{1c}-\x{1f}]+"), lambda w: w != "")
    n_words = F.size(words)
    matches = F.size(F.filter(words, lambda w: (F.length(w) > 3) & (F.instr(tl, w) > 0)))
    ratio = matches / n_words
    dom_confs = []
    for _, kws in K.DOMAIN_KEYWORDS:
        cat_hits = sum((F.instr(cl, F.lit(k)) > 0).cast("int") for k in kws)
        txt_hits = sum((F.instr(tl, F.lit(k)) > 0).cast("int") for k in kws)
        conf = F.least(F.lit(0.6), F.lit(0.3) + (txt_hits / F.lit(len(kws)) * 0.3))
        dom_confs.append(F.when((cat_hits > 0) & (txt_hits > 0), conf))
    dom_conf = F.greatest(F.lit(0.0), *[F.coalesce(c, F.lit(0.0)) for c in dom_confs])
    dom_valid = F.greatest(*[F.coalesce(c > 0.4, F.lit(False)) for c in dom_confs])
    tested = K.CONTEXT_INDICATORS[:1] if first_indicator_only else K.CONTEXT_INDICATORS
    in_context = F.lit(False)
    for word in tested:
        in_context = in_context | ctx.contains(word)
    conf = (
        F.when(direct, F.when(in_context, F.lit(0.95)).otherwise(F.lit(0.8)))
        .when(matches > 0, F.lit(0.3) + ratio * 0.4)
        .otherwise(dom_conf)
    )
    valid = F.when(direct, F.lit(True)).when(matches > 0, ratio >= 0.5).otherwise(dom_valid)
    empty = F.array().cast("array<string>")
    is_empty = F.col(category).isNull() | (F.col(category) == "") | (cl == "uncategorized")
    section = cl.isin(K.SITE_SECTIONS)
    d = d.withColumn("_conf", conf)
    return d.select(
        *[c for c in df.columns],
        F.when(is_empty | section, F.lit(0.1)).otherwise(F.col("_conf")).alias("category_confidence"),
        F.when(is_empty | section, F.lit(False)).otherwise(valid).alias("is_valid_category"),
        F.when(is_empty, empty).when(section, F.array(F.lit(K.SITE_SECTION_SUGGESTION)))
        .when(F.col("_conf") < K.SUGGEST_BELOW, category_suggestions(tl)).otherwise(empty).alias("category_suggestions"),
    )


def category_relabel(items: DataFrame) -> DataFrame:
    """Categories other than 'Uncategorized' are scored against the chunk text; below
    0.3 the category becomes 'Uncategorized (Low Confidence)' with the original and the
    suggestions kept.  'Uncategorized' gets 0.0 / false."""
    scored = category_score(items)
    unc = F.col("category") == K.UNCATEGORIZED
    low = ~unc & (F.col("category_confidence") < K.RELABEL_BELOW)
    return scored.select(
        *[c for c in items.columns if c != "category"],
        F.when(low, F.lit(K.UNCATEGORIZED_LOW)).otherwise(F.col("category")).alias("category"),
        F.when(unc, F.lit(0.0)).otherwise(F.col("category_confidence")).alias("category_confidence"),
        F.when(unc, F.lit(False)).otherwise(F.col("is_valid_category")).alias("is_valid_category"),
        F.when(low, F.col("category")).alias("category_original"),
        F.when(low, F.col("category_suggestions")).alias("category_suggestions"),
    )
