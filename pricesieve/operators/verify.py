"""Completeness check of extracted products (group V).

Tables of texts, matches and chunk offsets are joined by merge: their size is guessed from the files they
are derived from, far under what they hold, so they would be broadcast through the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricesieve import constants as K
from pricesieve.functions.text import pystrip
from pricesieve.session import materialize


def findings(products: DataFrame, name_col: str = "product_name") -> DataFrame:
    """V1-V3: one row per (kind, row_id): names missing or shorter than 3 characters after
    stripping, prices missing or 'Unknown' (not the 'Price not found' sentinel), category
    confidence below 0.4."""
    name = F.col(name_col)
    short = name.isNull() | (name == "") | (F.length(pystrip(name)) < K.SHORT_NAME_MIN)
    price = F.col("price")
    no_price = price.isNull() | (price == "") | (price == K.UNKNOWN)
    low = F.coalesce(F.col("category_confidence") < K.LOW_CONFIDENCE_BELOW, F.lit(False))
    kinds = [F.when(test, F.lit(kind)) for (kind, _), test in zip(K.FINDING_MESSAGES, (short, no_price, low))]
    return products.select(F.explode(F.array_compact(F.array(*kinds))).alias("kind"), "row_id")


def text_findings(products: DataFrame, missed: DataFrame, name_col: str = "product_name") -> DataFrame:
    """V5/V6 with the texts at hand: one row (kind) per finding.  The ``missed`` indicators (V4)
    take the place of the name check; prices and confidences are checked as ever."""
    by_name = K.FINDING_MESSAGES[0][0]
    checked = findings(products, name_col).filter(F.col("kind") != by_name).select("kind")
    return missed.select(F.lit(by_name).alias("kind")).unionByName(checked)


def suggestions(found: DataFrame, messages=K.FINDING_MESSAGES) -> DataFrame:
    """V5: one message per finding kind with at least one finding."""
    counts = found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    msg = F.lit(None).cast("string")
    for kind, text in messages:
        pre, post = text.split("{n}")
        msg = F.when(F.col("kind") == kind, F.concat(F.lit(pre), F.col("n").cast("string"), F.lit(post))).otherwise(msg)
    return counts.select("kind", "n", msg.alias("suggestion"))


def completeness(found: DataFrame) -> DataFrame:
    """V6: 1.0 without findings, else max(0, 1 - 0.05 * findings); warning below 0.9."""
    n = found.agg(F.count(F.lit(1)).alias("n_findings"))
    score = F.when(F.col("n_findings") == 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - F.col("n_findings") * K.COMPLETENESS_STEP))
    return n.select("n_findings", score.alias("completeness_score")).withColumn(
        "warning", F.col("completeness_score") < K.COMPLETENESS_WARN_BELOW)



def indicator_matches(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Matches of the indicator patterns (case-insensitive) in each chunk, with the text
    100 characters either side and the position (scanned per chunk)."""
    from pricesieve.operators.text import match_spans, span_windows
    c = chunks.select(key, "url", "text")
    spans = match_spans(c, key, "text", ["(?iU)" + p for p, _ in K.PRODUCT_INDICATORS])
    spans = spans.join(c.select(key, "url", F.length("text").alias("_len")).hint("merge"), key)
    spans = spans.withColumn("_lo", F.greatest(F.col("start") - K.INDICATOR_WINDOW, F.lit(0))) \
                 .withColumn("_hi", F.least(F.col("_len"), F.col("end") + K.INDICATOR_WINDOW))
    spans = span_windows(c, key, "text", spans, [key, "pattern_no", "match_no"], "_lo", "_hi", "context")
    return spans.select(key, "url", F.col("pattern_no").alias("indicator_no"), _indicator_type().alias("type"), "match",
                        "context", F.col("start").alias("position"))


#: Characters of a block of a site's joined text; a block is scanned with the whole block before
#: and after it, so a match may be as long as that less the context.
PAGE_BLOCK = 4096


def page_blocks(chunks: DataFrame, site: str = "url", key: str = "chunk_id", block: int = PAGE_BLOCK) -> DataFrame:
    """(site, block, before, text, after): the texts of a site's chunks joined by spaces in order of
    ``key``, cut into blocks of fixed length, each with its neighbours.  A site's text is never
    in one row: chunks get their offset from narrow running sums (per bucket of keys, then within
    a bucket) and send each block its pieces.  Null texts count as ''."""
    per_bucket = 4096
    c = chunks.select(site, key, F.coalesce("text", F.lit("")).alias("text"))
    narrow = c.select(site, key, F.floor(F.col(key) / per_bucket).alias("_b"), (F.length("text") + 1).alias("n"))
    totals = narrow.groupBy(site, "_b").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(site).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(site, "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(site, "_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    at = narrow.join(totals.hint("merge"), [site, "_b"]).select(site, key, (F.col("_base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("at"))
    # every chunk but the first brings the space before it
    first = F.col("at") == 0
    c = c.join(at.hint("merge"), [site, key]).select(site, F.when(first, F.col("at")).otherwise(F.col("at") - 1).alias("at"),
                                       F.when(first, F.col("text")).otherwise(F.concat(F.lit(" "), F.col("text"))).alias("text"))
    c = c.where(F.length("text") > 0)
    last = F.floor((F.col("at") + F.length("text") - 1) / block)
    pieces = c.select(site, "at", F.explode(F.transform(F.sequence(F.floor(F.col("at") / block), last), lambda b: F.struct(
        b.alias("block"), F.substring("text", F.greatest(b * block - F.col("at"), F.lit(0)).cast("int") + 1,
                                      F.least(F.lit(block), (b + 1) * block - F.col("at")).cast("int")).alias("piece")))).alias("p"))
    blocks = pieces.groupBy(site, F.col("p.block").alias("block")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("at", F.col("p.piece").alias("piece")))), lambda x: x["piece"]), "").alias("text"))
    roles = F.array(*(F.struct((F.col("block") + step).alias("block"), F.lit(role).alias("role"))
                      for step, role in ((1, "before"), (0, "text"), (-1, "after"))))
    sent = blocks.select(site, "text", F.explode(roles).alias("r")).select(site, "r.block", "r.role", "text")
    pick = [F.max(F.when(F.col("role") == r, F.col("text"))).alias(r) for r in ("before", "text", "after")]
    return sent.groupBy(site, "block").agg(*pick).where(F.col("text").isNotNull()).fillna("", ["before", "after"])


def page_indicator_matches(chunks: DataFrame, block: int = PAGE_BLOCK) -> DataFrame:
    """The matches of :func:`indicator_matches` in the joined text of each site, with positions and
    contexts there.  A match belongs to the block it starts in, so one that spans chunks or blocks
    counts once."""
    from pricesieve.operators.text import match_spans
    blocks = materialize(page_blocks(chunks, block=block).withColumn("whole", F.concat("before", "text", "after")))
    spans = match_spans(blocks, ["url", "block"], "whole", ["(?iU)" + p for p, _ in K.PRODUCT_INDICATORS])
    left = F.length("before")
    m = spans.join(blocks.hint("merge"), ["url", "block"]).where((F.col("start") >= left) & (F.col("start") < left + F.length("text")))
    lo = F.greatest(F.col("start") - K.INDICATOR_WINDOW, F.lit(0))
    return m.select("url", F.col("pattern_no").alias("indicator_no"), _indicator_type().alias("type"), "match",
                    F.substring("whole", lo + 1, F.col("end") + K.INDICATOR_WINDOW - lo).alias("context"),
                    (F.col("block") * block + F.col("start") - left).cast("int").alias("position"))


def _indicator_type():
    kinds = F.lit(None).cast("string")
    for i, (_, kind) in enumerate(K.PRODUCT_INDICATORS):
        kinds = F.when(F.col("pattern_no") == i, F.lit(kind)).otherwise(kinds)
    return kinds


def _rarest_gram(names: DataFrame, site: str, q: int) -> DataFrame:
    """Adds to each (site, name) its ``gram``: of its substrings of q characters (the name, if
    shorter) the one that fewest names of the site have."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("name") - q + 1, F.lit(1)))
    grams = names.select(site, "name", F.explode(F.array_distinct(F.transform(
        starts, lambda i: F.substring(F.col("name"), i, F.lit(q))))).alias("gram"))
    seen = grams.groupBy(site, "gram").agg(F.count(F.lit(1)).alias("seen"))
    return grams.join(seen, [site, "gram"]).groupBy(site, "name").agg(F.min(F.struct("seen", "gram")).alias("g")).select(
        site, "name", "g.gram")


def contains_any(left: DataFrame, text_col: str, names: DataFrame, keys, site: str = "url",
                 q: int = K.NAME_GRAM) -> DataFrame:
    """Rows of ``left`` (identified by ``keys``) whose ``text_col`` (lower-cased) contains
    any name of the same site.  Exact, and never pairs a row with every name of a site: a
    name can only occur where each of its substrings of ``q`` characters occurs, so names are
    keyed by their rarest one (names with a common beginning or word don't meet in one key),
    each text emits its distinct substrings of the lengths its site's names need, and only
    pairs sharing a key are tested."""
    nm = names.select(site, F.lower(F.col("name")).alias("name")).filter(F.col("name") != "").distinct()
    nm = materialize(_rarest_gram(materialize(nm), site, q))
    # at most q lengths a site, usually q alone
    lengths = nm.groupBy(site).agg(F.collect_set(F.length("gram")).alias("_ks"))
    lt = left.select(*keys, F.lower(F.col(text_col)).alias("_low"), *([] if site in keys else [site])).join(lengths, site)
    row = list(dict.fromkeys([*keys, site]))
    # substrings travel without their text; it comes back for those that are a name's key
    grams = lt.select(*row, F.explode(F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("_low"), F.lit(1))),
        lambda i: F.transform("_ks", lambda k: F.substring("_low", i, k)))))).alias("gram"))
    near = grams.filter(F.col("gram") != "").join(nm, [site, "gram"]).select(*row, "name")
    hits = near.join(lt.select(*row, "_low").hint("merge"), row).filter(F.instr(F.col("_low"), F.col("name")) > 0)
    return left.join(hits.select(*keys).distinct().hint("merge"), list(keys), "left_semi")


def _site_names(products: DataFrame, name_col: str) -> DataFrame:
    name = F.coalesce(F.col(name_col).cast("string"), F.lit("")) if name_col in products.columns else F.lit("")
    return products.select(F.col("source_url").alias("url"), name.alias("name"))


def indicators(chunks: DataFrame, products: DataFrame, name_col: str = "product_name", key: str = "chunk_id") -> DataFrame:
    """V4 per chunk: indicator matches whose context contains no known product name of the site
    (names lower-cased; empty names ignored).  A match never spans two chunks here; for the
    joined text of a site see :func:`page_indicators`."""
    m = materialize(indicator_matches(chunks, key))
    keys = [key, "indicator_no", "position"]
    known = contains_any(m, "context", _site_names(products, name_col), keys)
    return m.join(known.select(*keys).hint("merge"), keys, "left_anti")


def page_indicators(chunks: DataFrame, products: DataFrame, name_col: str = "product_name", block: int = PAGE_BLOCK) -> DataFrame:
    """V4 over the joined text of each site: as :func:`indicators`, with matches and contexts
    that cross the ends of chunks."""
    m = materialize(page_indicator_matches(chunks, block))
    keys = ["url", "indicator_no", "position"]
    known = contains_any(m, "context", _site_names(products, name_col), keys)
    return m.join(known.select(*keys).hint("merge"), keys, "left_anti")
