"""Fuel retailer pages: detection, price pairing by line position and patterns
(group D12-D17, D20)."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricesieve import constants as K
from pricesieve.functions.text import match_pieces, pystrip


def is_fuel_chunk(url: Column, text: Column) -> Column:
    """A fuel-retailer word in the lower-cased URL, else a fuel word in the text
    (substring tests: 'def' also hits 'default')."""
    u, t = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    by_url = F.lit(False)
    for w in K.FUEL_URL_WORDS:
        by_url = by_url | u.contains(w)
    by_text = F.lit(False)
    for w in K.FUEL_TEXT_WORDS:
        by_text = by_text | t.contains(w)
    return by_url | by_text


def fuel_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("is_fuel", is_fuel_chunk(F.col("url"), F.col("text")))


def _lines(chunks: DataFrame, key: str) -> DataFrame:
    # splitlines(): \n, \r\n, \r and a few more separators
    return chunks.select(key, "url", F.posexplode(F.split(F.col("text"), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"))
                         .alias("line_no", "line"))


def _rows(df: DataFrame, key: str, name: Column, price: Column) -> DataFrame:
    return df.select(
        key, name.alias("product_name"), price.alias("price"), F.lit(K.FUEL_CATEGORY).alias("category"),
        F.concat(F.lit(K.FUEL_DESCRIPTION_PREFIX), F.col("url")).alias("description"), F.col("url").alias("source_url"),
    )


def fuel_price_above(chunks: DataFrame, key: str = "chunk_id", types=K.FUEL_TYPES_SHORT) -> DataFrame:
    """Each fuel type's last line (case-insensitive substring) takes the price of the
    closest earlier line with '$d.d'; only when the text holds at least as many prices as
    fuel types present, and at least one type."""
    t = F.col("text")
    n_prices = F.size(F.regexp_extract_all(t, F.lit(K.FUEL_PRICE_RE), 0))
    n_types = sum(F.lower(t).contains(x.lower()).cast("int") for x in types)
    ok = chunks.filter((n_types > 0) & (n_prices >= n_types)).select(key, "url", "text")
    ln = _lines(ok, key)
    typ = F.explode(F.filter(F.array(*[F.lit(x) for x in types]), lambda x: F.lower(F.col("line")).contains(F.lower(x))))
    fuel = ln.select(key, "url", "line_no", typ.alias("ftype")).groupBy(key, "url", "ftype").agg(
        F.max("line_no").alias("line_no"))
    price = ln.select(key, "line_no", F.regexp_extract("line", K.FUEL_PRICE_RE, 0).alias("price")).filter(F.col("price") != "")
    # backward as-of on the line number inside one chunk: union and carry the last price forward
    u = fuel.select(key, "url", "line_no", "ftype", F.lit(None).cast("string").alias("price"), F.lit(0).alias("k")) \
        .unionByName(price.select(key, F.lit(None).cast("string").alias("url"), "line_no",
                                  F.lit(None).cast("string").alias("ftype"), "price", F.lit(1).alias("k")))
    w = Window.partitionBy(key).orderBy("line_no", "k").rowsBetween(Window.unboundedPreceding, -1)
    u = u.withColumn("above", F.last("price", ignorenulls=True).over(w))
    hit = u.filter(F.col("ftype").isNotNull() & F.col("above").isNotNull())
    return _rows(hit, key, F.col("ftype"), F.col("above"))


def _first_type(line: Column, types) -> Column:
    out = F.lit(None).cast("string")
    for x in reversed(types):
        out = F.when(line.rlike(r"(?i)\b" + re.escape(x) + r"\b"), F.lit(x.upper())).otherwise(out)
    return out


def fuel_price_near(chunks: DataFrame, key: str = "chunk_id", types=K.FUEL_TYPES, within: int = K.FUEL_NEAR_LINES) -> DataFrame:
    """Every line naming a fuel type (first listed type that occurs as a whole word)
    takes the price of the nearest line with '$d.d', either side, ties to the earlier
    line; kept when at most ``within`` lines away."""
    ln = _lines(chunks, key)
    ln = ln.select(key, "url", "line_no", _first_type(F.col("line"), types).alias("ftype"),
                   F.when(F.col("line").rlike(K.FUEL_PRICE_RE),
                          F.concat(F.lit("$"), F.regexp_extract("line", K.FUEL_PRICE_RE, 1))).alias("price"))
    w_prev = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    w_next = Window.partitionBy(key).orderBy("line_no").rowsBetween(0, Window.unboundedFollowing)
    pl = F.when(F.col("price").isNotNull(), F.col("line_no"))
    ln = ln.withColumn("prev_line", F.last(pl, ignorenulls=True).over(w_prev)) \
           .withColumn("prev_price", F.last("price", ignorenulls=True).over(w_prev)) \
           .withColumn("next_line", F.first(pl, ignorenulls=True).over(w_next)) \
           .withColumn("next_price", F.first("price", ignorenulls=True).over(w_next))
    f = ln.filter(F.col("ftype").isNotNull())
    dp = F.col("line_no") - F.col("prev_line")
    dn = F.col("next_line") - F.col("line_no")
    use_prev = F.col("prev_line").isNotNull() & (F.col("next_line").isNull() | (dp <= dn))
    dist = F.when(use_prev, dp).otherwise(dn)
    price = F.when(use_prev, F.col("prev_price")).otherwise(F.col("next_price"))
    f = f.withColumn("dist", dist).withColumn("p", price).filter(F.col("p").isNotNull() & (F.col("dist") <= within))
    return _rows(f, key, F.col("ftype"), F.col("p"))


def _pattern_with(i: int):
    return lambda x: F.struct(F.lit(i).alias("pattern_no"), x["g1"].alias("g1"), x["g2"].alias("g2"))


def fuel_regex(chunks: DataFrame, key: str = "chunk_id", patterns=K.FUEL_REGEXES) -> DataFrame:
    """Three general patterns, case-insensitive; when group 1 holds '$' it is the
    price and group 2 the name (so the first pattern names 'PER' or '/'), else the
    reverse."""
    arrs = []
    for i, p in enumerate(patterns):
        rx = F.lit("(?iU)" + p)
        z = F.arrays_zip(F.regexp_extract_all("text", rx, 1).alias("g1"), F.regexp_extract_all("text", rx, 2).alias("g2"))
        arrs.append(F.transform(z, _pattern_with(i)))
    d = chunks.select(key, "url", F.posexplode(F.concat(*arrs)).alias("pos", "m"))
    dollar = F.col("m.g1").contains("$")
    name = F.upper(pystrip(F.when(dollar, F.col("m.g2")).otherwise(F.col("m.g1"))))
    price = pystrip(F.when(dollar, F.col("m.g1")).otherwise(F.col("m.g2")))
    return d.select(key, "pos", F.col("m.pattern_no").alias("pattern_no"), name.alias("product_name"),
                    price.alias("price"), F.lit(K.FUEL_CATEGORY).alias("category"),
                    F.concat(F.lit(K.FUEL_DESCRIPTION_PREFIX), F.col("url")).alias("description"),
                    F.col("url").alias("source_url"))


def _cat_with(i: int):
    return lambda m: F.struct(F.lit(i).alias("pattern_no"), m.alias("m"))


def fuel_patterns(chunks: DataFrame, key: str = "chunk_id", patterns=K.FUEL_CATEGORY_PATTERNS) -> DataFrame:
    """The fuel category patterns (case-insensitive); a match with a '$n' price gives
    a row: the rest of the match is the type, else a type inferred from the text."""
    arrs = [F.transform(F.regexp_extract_all("text", F.lit("(?iU)" + p), 0), _cat_with(i)) for i, p in enumerate(patterns)]
    d = chunks.select(key, "url", "text", F.posexplode(F.concat(*arrs)).alias("pos", "x"))
    m = F.col("x.m")
    price = F.regexp_extract(m, r"\$\d+\.?\d*", 0)
    rest = pystrip(F.regexp_replace(m, r"\$\d+\.?\d*", ""))
    low = F.lower("text")
    fallback = F.lit(K.FUEL_DEFAULT_NAME)
    for word, name in reversed(K.FUEL_FALLBACK_NAMES):
        fallback = F.when(low.contains(word), F.lit(name)).otherwise(fallback)
    d = d.withColumn("price", price).filter(F.col("price") != "")
    return d.select(key, "pos", F.col("x.pattern_no").alias("pattern_no"),
                    F.when(rest != "", rest).otherwise(fallback).alias("product_name"), "price",
                    F.lit(K.FUEL_CATEGORY).alias("category"),
                    F.concat(F.lit(K.FUEL_DESCRIPTION_PREFIX), F.col("url")).alias("description"),
                    F.col("url").alias("source_url"))


def style(text: Column) -> Column:
    """Presentation style from the lower-cased text, first rule that holds."""
    t = F.lower(text)

    def any_of(words):
        c = F.lit(False)
        for w in words:
            c = c | t.contains(w)
        return c

    rules = dict((k, v) for k, v in K.STYLE_RULES)
    grid = t.contains("<div class=") & (t.contains("product") | t.contains("grid"))
    menu = t.contains("menu") & (t.contains("$") | t.contains("price"))
    return (
        F.when(any_of(rules["table"]), "table")
        .when(any_of(rules["bullet_list"]), "bullet_list")
        .when(grid, "grid")
        .when(menu, "menu")
        .when(any_of(rules["packages"]), "packages")
        .when(any_of(rules["fuel_prices"]), "fuel_prices")
        .otherwise("unknown")
    )


# ------------------------------------------------------------- text nodes
CONTAINER_TAGS = ["div", "p", "li", "tr", "td", "th", "span", "section", "article", "h1", "h2", "h3", "h4", "h5",
                  "h6", "ul", "ol", "table", "body", "header", "footer", "nav", "main"]


def text_nodes(pages: DataFrame, key: str = "chunk_id", html: str = "text") -> DataFrame:
    """HTML as a sequence of text nodes with a container number: the container changes at
    every container tag (open or close); inline tags (b, i, a, em, strong, ...) do not
    split a container.  Comments, scripts and styles are dropped; entities decoded."""
    from pricesieve.functions.html import strip_invisible, unescape
    h = strip_invisible(F.col(html))
    pieces = match_pieces(h, r"<[^>]*>")
    d = pages.select(key, "url", F.posexplode(pieces).alias("pos", "piece"))
    is_tag = F.col("piece").startswith("<")
    cont_tag = F.col("piece").rlike(r"(?i)^</?(?:" + "|".join(CONTAINER_TAGS) + r")\b")
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("container", F.sum((is_tag & cont_tag).cast("int")).over(w))
    return d.filter(~is_tag & (F.col("piece") != "")).select(key, "url", "pos", "container",
                                                           unescape(F.col("piece")).alias("node"))


def fuel_price_nodes(pages: DataFrame, key: str = "chunk_id", html: str = "text", types=K.FUEL_TYPES) -> DataFrame:
    """D15 (re-aimed without a DOM): every distinct text node naming a fuel type (types
    in list order, then document order) takes the first price node of its container,
    else the last price node of an earlier container, else the first of a later one.
    Name = the node stripped and upper-cased; price = the price node stripped."""
    n = text_nodes(pages, key, html)
    price_rx = r"\$\d+\.\d+"
    is_price = F.col("node").rlike(price_rx)
    # fuel nodes: which types hit, the first type (list order) fixes the discovery order
    hits = [F.when(F.col("node").rlike("(?i)" + re.escape(t)), F.lit(i)) for i, t in enumerate(types)]
    n = n.withColumn("type_no", F.least(*hits)).withColumn("is_price", is_price)
    prices = n.filter("is_price")
    # per container: its first price node
    cont_price = prices.groupBy(key, "container").agg(F.min_by("node", "pos").alias("cp"))
    w_prev = Window.partitionBy(key).orderBy("container").rowsBetween(Window.unboundedPreceding, -1)
    w_next = Window.partitionBy(key).orderBy("container").rowsBetween(1, Window.unboundedFollowing)
    conts = n.select(key, "container").distinct().join(cont_price, [key, "container"], "left")
    last_in = prices.groupBy(key, "container").agg(F.max_by("node", "pos").alias("lp"))
    conts = conts.join(last_in, [key, "container"], "left")
    conts = conts.withColumn("prev_p", F.last("lp", ignorenulls=True).over(w_prev)) \
                 .withColumn("next_p", F.first("cp", ignorenulls=True).over(w_next))
    fuel_nodes = n.filter(F.col("type_no").isNotNull())
    # a text repeated in several nodes is one element: keep the first by (type, position)
    first = fuel_nodes.groupBy(key, "node").agg(F.min_by(F.struct("container", "pos", "url"),
                                                         F.struct("type_no", "pos")).alias("f"))
    f = first.select(key, "node", "f.container", "f.pos", "f.url").join(conts, [key, "container"], "left")
    price = F.coalesce("cp", "prev_p", "next_p")
    f = f.withColumn("p", price).filter(F.col("p").isNotNull())
    return _rows(f, key, F.upper(pystrip(F.col("node"))), pystrip(F.col("p")))
