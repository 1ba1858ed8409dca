"""Booking pages: service cards and provider/service patterns (D18, D19, D19b), and the
mapping of items from an external extractor (D28).

Cards are re-aimed without a DOM: a card is the stretch of HTML from an opening tag
whose class names a card (card / service / offering / block; else item) to the next
such tag.  Fields are read from the first element inside the card whose tag or class
matches, as the text up to the next tag.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricesieve import constants as K
from pricesieve.functions.html import unescape
from pricesieve.functions.text import cut_before, pystrip


def _class_re(classes) -> str:
    return r"""class\s*=\s*"[^"]*(?:""" + "|".join(classes) + r""")[^"]*\""""


def field_regex(tags, classes, exact_class: bool = True) -> str:
    """Regex of the first element with one of ``tags`` or a class in ``classes``; group 1
    is its text up to the next tag."""
    alts = []
    if tags:
        alts.append(r"<(?:" + "|".join(tags) + r")\b[^>]*>")
    if classes:
        cls = "|".join(classes)
        if exact_class:
            alts.append(r"""<[a-zA-Z][^>]*\bclass\s*=\s*"(?:[^"]*\s)?(?:""" + cls + r""")(?:\s[^"]*)?"[^>]*>""")
        else:
            alts.append(r"""<[a-zA-Z][^>]*\bclass\s*=\s*"[^"]*(?:""" + cls + r""")[^"]*"[^>]*>""")
    return "(?is)(?:" + "|".join(alts) + r")([^<]*)"


def _field(card: Column, tags, classes, exact_class: bool = True) -> Column:
    """Text of the first element (document order) with one of ``tags`` or a class in
    ``classes``: the text after its opening tag up to the next tag, stripped."""
    rx = field_regex(tags, classes, exact_class)
    found = F.regexp_extract(card, rx, 0) != ""
    return F.when(found, pystrip(unescape(F.regexp_extract(card, rx, 1))))


def _text(card: Column) -> Column:
    return unescape(F.regexp_replace(card, r"<[^>]*>", ""))


CARD_START = r"(?i)(<div\b[^>]*" + _class_re(K.CARD_CLASSES) + r"[^>]*>)"
CARD_START_FALLBACK = (r"(?i)(<(?:div\b[^>]*" + _class_re(K.CARD_CLASSES_FALLBACK) + r"|div\b[^>]*class\s*=\s*\"row\"|section\b[^>]*"
                       + _class_re(["service"]) + r")[^>]*>)")


def booking_cards(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Service cards of booking pages (URL contains book / appointment /
    schedule) -> provider, service, duration, price."""
    u = F.col(url)
    booking = F.lit(False)
    for w in K.BOOKING_URL_WORDS:
        booking = booking | u.contains(w)
    p = pages.filter(booking)
    start, start2 = CARD_START, CARD_START_FALLBACK
    has_cards = F.col(html).rlike(start)
    pieces = F.when(has_cards, cut_before(F.col(html), start)) \
        .otherwise(cut_before(F.col(html), start2))
    cards = p.select(key, F.col(url).alias("url"), F.posexplode(pieces).alias("card_no", "card")).filter("card_no > 0")
    c = F.col("card")
    prov = F.coalesce(_field(c, K.PROVIDER_TAGS, K.PROVIDER_CLASSES), F.lit(""))
    prov2 = F.coalesce(_field(c, K.PROVIDER_TAGS_2, K.PROVIDER_CLASSES_2), F.lit(""))
    provider = F.when(prov != "", prov).otherwise(prov2)
    service = F.coalesce(_field(c, K.SERVICE_TAGS, K.SERVICE_CLASSES), F.lit(K.CONSULTATION))
    dur_el = _field(c, None, K.DURATION_CLASSES + ["[^\"]*minute"], exact_class=False)
    text = _text(c)
    duration = F.when(F.coalesce(dur_el, F.lit("")) != "", dur_el) \
        .otherwise(F.regexp_extract(text, r"(\d+)\s*minutes", 0))
    price_el = _field(c, None, ["price", "cost"], exact_class=False)
    price = (
        F.when(price_el.isNotNull(), price_el)
        .when(text.rlike(r"\$(\d+)"), F.regexp_extract(text, r"\$(\d+)", 0))
        .when(F.lower(text).contains("free"), F.lit(K.FREE_WORD))
        .otherwise(F.lit(K.PRICE_NOT_FOUND))
    )
    d = cards.select(key, "url", "card_no", provider.alias("provider"), service.alias("service"),
                     duration.alias("duration"), price.alias("price"))
    d = d.filter((F.col("provider") != "") | (F.col("service") != K.CONSULTATION))
    svc = pystrip(F.regexp_replace(F.regexp_replace("service", r"\d+\s*minutes", ""), r"\$\d+", ""))
    return _product_rows(d, key, svc, "card_no")


def _category(url: Column) -> Column:
    low = F.lower(url)
    legal = F.lit(False)
    for w in K.LEGAL_URL_WORDS:
        legal = legal | low.contains(w)
    return F.when(legal, F.lit(K.LEGAL_CATEGORY)).otherwise(F.lit(K.PROFESSIONAL_CATEGORY))


def _product_rows(d: DataFrame, key: str, service: Column, *order: str) -> DataFrame:
    prov = F.col("provider")
    name = F.when(prov != "", F.concat(prov, F.lit(" - "), service)).otherwise(service)
    desc = F.concat(F.col("duration"), F.when(prov != "", F.concat(F.lit(" with "), prov)).otherwise(F.lit("")))
    return d.select(key, *order, name.alias("product_name"), "price", _category(F.col("url")).alias("category"),
                    desc.alias("description"), F.col("url").alias("source_url"), "provider")


def _booking_with(i: int):
    return lambda x: F.struct(F.lit(i).alias("pattern_no"), x.alias("x"))


def booking_regex(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Provider + service patterns over the text with entities blanked; the price from
    the match, else 'Free' when the service says so, else the first '$n' within 100
    characters before / after the match start."""
    from pricesieve.operators.text import match_spans, span_windows
    t = pages.select(key, F.col(url).alias("url"), F.regexp_replace(F.col(html), r"&[a-z]+;", " ").alias("t"))
    spans = match_spans(t, key, "t", ["(?ism)" + p for p in K.BOOKING_PATTERNS])
    lens = t.select(key, "url", F.length("t").alias("_len"))
    spans = spans.join(lens, key)
    spans = spans.withColumn("_lo", F.greatest(F.col("start") - K.BOOKING_WINDOW, F.lit(0))) \
                 .withColumn("_hi", F.least(F.col("_len"), F.col("start") + K.BOOKING_WINDOW))
    spans = span_windows(t, key, "t", spans, [key, "pattern_no", "match_no"], "_lo", "_hi", "window")
    m = F.col("match")

    def grp(k, rx_i):
        return F.regexp_extract(m, "(?ism)^" + K.BOOKING_PATTERNS[rx_i], k)

    pat = F.col("pattern_no")
    g = {k: F.when(pat == 0, grp(k, 0)).when(pat == 1, grp(k, 1)).otherwise(grp(k, 2)) for k in (1, 2, 3, 4)}
    provider = pystrip(g[1])
    service = F.when(g[2] != "", pystrip(g[2])).otherwise(F.lit(K.CONSULTATION))
    duration = F.when(pat < 2, pystrip(g[3])).otherwise(F.lit(""))
    window = F.col("window")
    price = (
        F.when((pat == 0) & (g[4] != ""), F.concat(F.lit("$"), g[4]))
        .when(F.lower(service).contains("free"), F.lit(K.FREE_WORD))
        .when(window.rlike(r"\$(\d+)"), F.regexp_extract(window, r"\$(\d+)", 0))
        .otherwise(F.lit(K.PRICE_NOT_FOUND))
    )
    # rows are ordered by pattern, then by match
    d = spans.select(key, "url", "match_no", "pattern_no",
                     provider.alias("provider"), service.alias("service"), duration.alias("duration"),
                     price.alias("price"))
    return _product_rows(d, key, F.col("service"), "pattern_no", "match_no")


def item_map(items: DataFrame) -> DataFrame:
    """External items as products: defaults for missing fields, confidence 0.8,
    valid, the extractor's name; brand / availability / image / sku carried when present."""
    return items.select(
        "item_id",
        F.coalesce("name", F.lit(K.UNKNOWN)).alias("product_name"),
        F.coalesce("price", F.lit(K.PRICE_NOT_FOUND)).alias("price"),
        F.coalesce("category", F.lit(K.UNCATEGORIZED)).alias("category"),
        F.coalesce("description", F.lit(K.NO_DESCRIPTION)).alias("description"),
        F.col("url").alias("source_url"),
        F.coalesce("category", F.lit(K.UNCATEGORIZED)).alias("original_category"),
        F.lit(K.EXTERNAL_CONFIDENCE).alias("category_confidence"),
        F.lit(True).alias("is_valid_category"),
        F.lit(K.EXTERNAL_EXTRACTOR).alias("extracted_by"),
        "brand", "availability", "image_url", "sku",
    )
