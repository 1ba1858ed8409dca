"""Menu and price-list extraction from document text (group D1-D11)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricesieve import constants as K
from pricesieve.functions.text import match_pieces, pystrip
from pricesieve.operators.text import lines
from pricesieve.session import materialize


def menu_line_end(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A price of the form ``d.dd`` / ``dd.dd`` closing a line; the item is the
    text before it with trailing dots and spaces cut; kept when longer than 3."""
    ln = lines(docs, key)
    m = F.regexp_extract("line", r"^(.*?)" + K.LINE_END_PRICE, 2)
    item = F.regexp_replace(pystrip(F.regexp_extract("line", r"^(.*?)" + K.LINE_END_PRICE, 1)), r"(?U)[\s.]+$", "")
    out = ln.select(key, "line_no", item.alias("item"), m.alias("price")).filter(
        (F.col("price") != "") & (F.length("item") > 3)
    )
    return out.withColumn("currency", F.lit("$"))


def _lines_all(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All lines with their raw text and the stripped previous / next line."""
    from pyspark.sql import Window
    ln = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "raw"))
    w = Window.partitionBy(key).orderBy("line_no")
    return ln.withColumn("prev", pystrip(F.lag("raw").over(w))).withColumn("next", pystrip(F.lead("raw").over(w)))


def _matches(line, pattern: str):
    """Array of (match_no, match, before, after) for every match of ``pattern`` in ``line``:
    the line is cut at its matches."""
    pieces = match_pieces(line, pattern)
    n = F.floor((F.size(pieces) - 1) / 2).cast("int")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda k: F.struct(
            k.alias("match_no"), F.element_at(pieces, 2 * k).alias("m"),
            F.array_join(F.slice(pieces, 1, 2 * k - 1), "").alias("before"),
            F.array_join(F.slice(pieces, 2 * k + 1, F.size(pieces)), "").alias("after"),
        ),
    ), n


def _tag_with(i: int):
    # one-argument lambda: transform() passes the element index to two-argument lambdas
    return lambda x: F.struct(F.lit(i).alias("pattern_no"), x.alias("x"))


def _item_with(i: int):
    return lambda x: F.struct(F.lit(i).alias("pattern_no"), x["item"].alias("item"), x["price"].alias("price"))


def prices(docs: DataFrame, key: str = "doc_id", patterns=K.PRICE_PATTERNS) -> DataFrame:
    """Every match of every currency pattern on every line: one row per
    (line, pattern, match); a price can be found by several patterns."""
    ln = _lines_all(docs, key)
    found = []
    for i, p in enumerate(patterns):
        arr, n = _matches(F.col("raw"), "(?U)" + p)
        found.append(F.when(n > 0, F.transform(arr, _tag_with(i)))
                     .otherwise(F.array().cast(f"array<struct<pattern_no:int,x:struct<match_no:int,m:string,"
                                               f"before:string,after:string>>>")))
    out = ln.select(key, "line_no", "prev", "next", F.explode(F.concat(*found)).alias("f"))
    return out.select(key, "line_no", "prev", "next", F.col("f.pattern_no").alias("pattern_no"),
                      F.col("f.x.match_no").alias("match_no"), F.col("f.x.m").alias("price"),
                      F.col("f.x.before").alias("before"), F.col("f.x.after").alias("after"))


def line_items(docs: DataFrame, key: str = "doc_id", source_url: str | None = "source_url") -> DataFrame:
    """A product per price match: name = text before the match, else the previous
    line, else the text after, else the next line; leading digits / dots / spaces cut;
    kept when longer than 3 characters."""
    p = prices(docs, key)
    before, after = pystrip(F.col("before")), pystrip(F.col("after"))
    prev = F.coalesce(F.col("prev"), F.lit(""))
    nxt = F.coalesce(F.col("next"), F.lit(""))
    pre = F.when(before != "", before).otherwise(prev)
    post = F.when(after != "", after).otherwise(nxt)
    name = F.when(pre != "", pre).otherwise(post)
    name = pystrip(F.regexp_replace(name, r"(?U)^[\d.\s]+", ""))
    out = p.select(key, "line_no", "pattern_no", "match_no", name.alias("product_name"), "price")
    out = out.filter(F.length("product_name") > 3)
    return out.withColumn("category", F.lit("Extracted from PDF")).withColumn("extracted_by", F.lit("PDF Extractor"))


def menu_sections(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Capital header lines (found between newlines) name the section of the items
    below them ('General Menu' before the first); an item is the text before the first
    price on a line, leading digits / dots / spaces cut."""
    from pyspark.sql import Window
    headers = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(K.SECTION_HEADER_PATTERN), 1))
    ln = docs.select(key, headers.alias("h"), F.split(F.col("text"), "\n").alias("l"))
    # a line is a header line when one of its document's headers occurs in it
    ln = ln.select(key, F.posexplode(F.transform("l", lambda x: F.struct(
        x.alias("raw"), F.exists("h", lambda h: F.contains(x, h)).alias("is_header")))).alias("line_no", "x"))
    ln = ln.select(key, "line_no", "x.raw", "x.is_header")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    sect = F.last(F.when(F.col("is_header"), pystrip(F.col("raw"))), ignorenulls=True).over(w)
    ln = ln.withColumn("category", F.coalesce(sect, F.lit(K.GENERAL_MENU)))
    price = F.regexp_extract("raw", "(?U)" + K.SECTION_PRICE_PATTERN, 1)
    items = ln.filter(~F.col("is_header")).withColumn("price", price).filter(F.col("price") != "")
    name = pystrip(F.split_part(F.col("raw"), F.col("price"), F.lit(1)))
    items = items.withColumn("nm", name).filter(F.col("nm") != "")
    return items.select(key, "line_no", F.regexp_replace("nm", r"(?U)^[\d.\s]+", "").alias("product_name"),
                        "price", "category")


_LEAD, _REST = r"[A-Za-z\s\'\"]", r"[\w\s\'\"\-\,\(\)]"


def _single_lead(p: str) -> str:
    """``[X]+[Y]*`` with X inside Y (greedy) matches exactly what ``[X][Y]*`` matches, with
    the same groups, but backtracks linearly instead of quadratically."""
    return p.replace(_LEAD + "+" + _REST + "*)", _LEAD + _REST + "*)")


def menu_patterns(docs: DataFrame, key: str = "doc_id", patterns=K.MENU_ITEM_PATTERNS) -> DataFrame:
    """Each item pattern over the whole text; name (group 1, stripped) of at least 3
    characters; price (group 2) with ',' read as '.'."""
    arrs = []
    for i, p in enumerate(patterns):
        p = _single_lead(p)
        z = F.arrays_zip(F.regexp_extract_all(F.col("text"), F.lit("(?U)" + p), 1).alias("item"),
                         F.regexp_extract_all(F.col("text"), F.lit("(?U)" + p), 2).alias("price"))
        arrs.append(F.transform(z, _item_with(i)))
    out = docs.select(key, F.posexplode(F.concat(*arrs)).alias("pos", "f"))
    out = out.select(key, "pos", F.col("f.pattern_no").alias("pattern_no"), pystrip(F.col("f.item")).alias("item"),
                     F.replace(pystrip(F.col("f.price")), F.lit(","), F.lit(".")).alias("price"))
    return out.filter(F.length("item") >= 3).withColumn("currency", F.lit("$"))


def menu_lines(docs: DataFrame, key: str = "doc_id", found: DataFrame | None = None) -> DataFrame:
    """D3: 'name price' on one line, the name of letters, spaces, quotes and dashes, the
    price any of the nine currency forms (each form without its outer parentheses); a
    (name, price) already found by the line-item pass, or earlier in this pass, is
    skipped.  ``found``: the line items, where they are at hand."""
    alt = "|".join(p[1:-1] for p in K.PRICE_PATTERNS)
    rx = "(?U)" + K.MENU_LINE_NAME + "(" + alt + ")"
    ln = _lines_all(docs, key)
    z = F.arrays_zip(F.regexp_extract_all("raw", F.lit(rx), 1).alias("n"), F.regexp_extract_all("raw", F.lit(rx), 2).alias("p"))
    m = ln.select(key, "line_no", F.posexplode(z).alias("match_no", "x"))
    m = m.select(key, "line_no", "match_no", pystrip(F.col("x.n")).alias("product_name"), F.col("x.p").alias("price"))
    from pyspark.sql import Window
    w = Window.partitionBy(key, "product_name", "price").orderBy("line_no", "match_no")
    m = m.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    found = line_items(docs, key) if found is None else found
    seen = found.select(key, "product_name", "price").distinct()
    m = m.join(seen, [key, "product_name", "price"], "left_anti")
    return m.withColumn("category", F.lit(K.MENU_CATEGORY)).withColumn("extracted_by", F.lit(K.MENU_EXTRACTOR))


def _cur_with(i: int):
    return lambda x: F.struct(F.lit(i).alias("pattern_no"), x.alias("x"))


def menu_currency(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """On lines of at least 5 characters (stripped), every match of three price
    forms; the item is the text before the match (longer than 3); the currency is the
    first of euro, dollar, pound present on the line."""
    ln = docs.select(key, F.posexplode(F.split(F.col(text), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"))
                     .alias("line_no", "raw")).filter(F.length(pystrip(F.col("raw"))) >= K.CURRENCY_MIN_LINE)
    arrs = []
    for i, p in enumerate(K.CURRENCY_PATTERNS):
        arr, n = _matches(F.col("raw"), "(?U)" + p)
        arrs.append(F.when(n > 0, F.transform(arr, _cur_with(i))))
    allm = F.flatten(F.filter(F.array(*arrs), lambda a: a.isNotNull()))
    d = ln.select(key, "line_no", "raw", F.explode(allm).alias("f"))
    grp = F.coalesce(*[F.when(F.col("f.pattern_no") == i, F.regexp_extract(F.col("f.x.m"), "(?U)^" + p, 1))
                       for i, p in enumerate(K.CURRENCY_PATTERNS)])
    cur = F.lit("")
    for sym in reversed(K.CURRENCY_SYMBOLS):
        cur = F.when(F.col("raw").contains(sym), F.lit(sym)).otherwise(cur)
    out = d.select(key, "line_no", F.col("f.pattern_no").alias("pattern_no"), F.col("f.x.match_no").alias("match_no"),
                   pystrip(F.col("f.x.before")).alias("item"), grp.alias("price"), cur.alias("currency"))
    return out.filter(F.length("item") > 3)


def name_list(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The leading word of letters of each stripped line (not an 'Add to basket'
    line), longer than 3, price '0.00'; only for documents with more than 3 such names."""
    from pyspark.sql import Window
    ln = lines(docs, key).filter(~F.col("line").contains(K.ADD_TO_BASKET))
    nm = F.regexp_extract("line", "^" + K.NAME_LIST_PATTERN, 1)
    d = ln.select(key, "line_no", nm.alias("item")).filter(F.length("item") > 3)
    d = d.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    return d.filter(F.col("_n") > K.NAME_LIST_MIN_ITEMS).drop("_n") \
        .withColumn("price", F.lit(K.NAME_LIST_PRICE)).withColumn("currency", F.lit("$"))


def menu_items(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Line-end prices when a document has any; otherwise the seven patterns and
    the name list, keep-first distinct by lower-cased item, 'add to basket' items
    dropped.  Output order column ``seq``."""
    d7 = menu_line_end(docs, key).select(key, F.lit(0).alias("src"), F.col("line_no").alias("seq"),
                                         "item", "price", "currency")
    with_d7 = d7.select(key).distinct()
    rest = docs.join(with_d7, key, "left_anti")
    d8 = menu_patterns(rest, key).select(key, F.lit(1).alias("src"), F.col("pos").alias("seq"), "item", "price", "currency")
    d9 = name_list(rest, key).select(key, F.lit(2).alias("src"), F.col("line_no").alias("seq"), "item", "price", "currency")
    from pyspark.sql import Window
    fb = d8.unionByName(d9).filter(~F.lower("item").contains("add to basket"))
    w = Window.partitionBy(key, F.lower("item")).orderBy("src", "seq")
    fb = fb.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return d7.unionByName(fb)


def pdf_products(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Products of a document are its line items and menu lines; a document
    without any that is likely a menu takes its sectioned-menu items instead."""
    from pricesieve.operators.text import menu_docs
    a = line_items(docs, key).select(key, "line_no", "product_name", "price", "category", "extracted_by")
    b = menu_lines(docs, key).select(key, "line_no", "product_name", "price", "category", "extracted_by")
    prods = a.unionByName(b)
    have = prods.select(key).distinct()
    menus = menu_docs(docs.join(have, key, "left_anti")).filter("is_menu").select(key, "text")
    c = menu_sections(menus, key).select(key, "line_no", "product_name", "price", "category",
                                         F.lit(None).cast("string").alias("extracted_by"))
    return prods.unionByName(c)


def merge_absent(products: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """``products`` and those ``items`` whose name no product of the same document has (an
    item without a name counts as one with an empty name).  Items with the same new name all stay."""
    names = products.select(F.col(key).alias("_k"), F.coalesce("product_name", F.lit("")).alias("_n")).distinct()
    new = items.join(names, F.col(key).eqNullSafe(F.col("_k")) & (F.coalesce("product_name", F.lit("")) == F.col("_n")),
                     "left_anti")
    return products.unionByName(new, allowMissingColumns=True)


def document_products(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """D1-D4, D11, D11b together: line items (pass 1), menu lines (2) and the names only the
    description pass finds (3); the description goes to the first product of its name; then the
    menu items of a likely menu are merged by absent name (4).  A menu's items are its products
    where it has any, so only menus without products bring their sectioned items."""
    from pyspark.sql import Window

    from pricesieve.operators.text import menu_docs
    a = materialize(line_items(docs, key).withColumn("pass", F.lit(1)))  # read by all later passes
    b = menu_lines(docs, key, a).withColumn("pass", F.lit(2)).withColumn("pattern_no", F.lit(0))
    cols = [key, "pass", "line_no", "pattern_no", "match_no", "product_name", "price", "category", "extracted_by"]
    early = materialize(a.select(*cols).unionByName(b.select(*cols)))
    d = materialize(descriptions(docs, key, early).select(
        F.col(key).alias("_k"), F.col("product_name").alias("_n"), "description", "is_new", F.col("price").alias("_p")))
    w = Window.partitionBy(key, "product_name").orderBy("pass", "line_no", "pattern_no", "match_no")
    early = early.withColumn("_first", F.row_number().over(w) == 1)
    early = early.join(d.filter(~F.col("is_new")).select("_k", "_n", "description"),
                       (F.col(key) == F.col("_k")) & (F.col("product_name") == F.col("_n")) & F.col("_first"), "left")
    late = d.filter("is_new").select(F.col("_k").alias(key), F.lit(3).alias("pass"), F.col("_n").alias("product_name"),
                                     F.col("_p").alias("price"), F.lit(K.MENU_CATEGORY).alias("category"),
                                     F.lit(K.MENU_EXTRACTOR).alias("extracted_by"), "description")
    products = early.select(*cols, "description").unionByName(late, allowMissingColumns=True)
    bare = docs.join(products.select(key).distinct(), key, "left_anti")
    menus = menu_docs(bare).filter("is_menu").select(key, "text")
    items = menu_sections(menus, key).withColumn("pass", F.lit(4))
    return merge_absent(products, items, key)


def descriptions(docs: DataFrame, key: str = "doc_id", found: DataFrame | None = None) -> DataFrame:
    """Description blocks.  A line with a price and a usable name (text before the
    first match of the first pattern giving one, leading digits cut, longer than 3)
    opens a block for that product; following lines without a price are its
    description, up to a blank line that comes after at least one of them (a blank line
    before any description keeps the block open; a price line whose name is unusable
    changes nothing).  Per product name the last non-empty description wins; names not
    found by the earlier passes become new products with the price of their first block.  ``found``: the products of the earlier
    passes, where they are at hand.
    """
    from pyspark.sql import Window
    ln = lines(docs, key, keep_blank=True)
    line = F.col("line")
    has_price = F.lit(False)
    cand = []
    for p in K.PRICE_PATTERNS:
        rx = "(?U)" + p
        has_price = has_price | line.rlike(rx)
        before = F.regexp_extract(line, r"(?U)^(.*?)" + p, 1)
        name = pystrip(F.regexp_replace(pystrip(before), r"(?U)^[\d.\s]+", ""))
        price = F.regexp_extract(line, rx, 1)
        cand.append(F.when(line.rlike(rx) & (F.length(name) > 3), F.struct(name.alias("n"), price.alias("p"))))
    d = ln.withColumn("has_price", has_price).withColumn("blank", line == "").withColumn("start", F.coalesce(*cand))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("block", F.sum(F.col("start").isNotNull().cast("int")).over(w))
    d = d.withColumn("is_text", ~F.col("blank") & ~F.col("has_price"))
    wb = Window.partitionBy(key, "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("text_before", F.coalesce(F.sum(F.col("is_text").cast("int")).over(wb), F.lit(0)))
    d = d.withColumn("closer", F.col("blank") & (F.col("text_before") > 0))
    d = d.withColumn("closed", F.coalesce(F.max(F.col("closer").cast("int")).over(wb), F.lit(0)) == 1)
    blocks = d.filter(F.col("start").isNotNull()).select(key, "block", F.col("line_no").alias("block_line"),
                                                         F.col("start.n").alias("product_name"),
                                                         F.col("start.p").alias("price"))
    texts = d.filter(F.col("is_text") & (F.col("block") > 0) & ~F.col("closed")).groupBy(key, "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ")
        .alias("description"))
    b = blocks.join(texts, [key, "block"], "left")
    per_name = b.groupBy(key, "product_name").agg(
        F.max_by("description", F.when(F.col("description").isNotNull(), F.col("block_line"))).alias("description"),
        F.min_by("price", "block_line").alias("price"),
    )
    if found is None:
        found = line_items(docs, key).select(key, "product_name").unionByName(
            menu_lines(docs, key).select(key, "product_name"))
    earlier = found.select(key, "product_name").distinct().withColumn("_old", F.lit(True))
    out = per_name.join(earlier, [key, "product_name"], "left")
    return out.select(key, "product_name", "description", F.col("_old").isNull().alias("is_new"),
                      F.when(F.col("_old").isNull(), F.col("price")).alias("price"))
