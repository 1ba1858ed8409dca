"""Text preparation operators (group C): lines, chunks, HTML to text, repairs, metrics."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricesieve import constants as K
from pricesieve.functions.text import match_pieces, pystrip


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_blank: bool = False) -> DataFrame:
    """Split each text on '\\n' into numbered lines (0-based position in the text),
    stripped; blank lines dropped unless ``keep_blank``.

    Line numbers keep the raw position so that "previous / next line" stays exact
    even when blank lines are dropped.
    """
    out = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "raw"))
    out = out.select(key, "line_no", pystrip("raw").alias("line"))
    if not keep_blank:
        out = out.filter(F.col("line") != "")
    return out


# ----------------------------------------------------------------- HTML
def html_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Page text as the crawler keeps it (one line, white space collapsed)."""
    from pricesieve.functions.html import html_text as _t
    return pages.withColumn("content", _t(F.col(html))).drop(html)


def html_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """Page text for chunking (block elements on their own lines)."""
    from pricesieve.functions.html import html_blocks as _b
    return pages.withColumn("text", _b(F.col(html))).drop(html)


# ------------------------------------------------------------- chunking
def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", url: str | None = "url",
           size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """Sliding character windows; start advances by ``size - overlap`` while it is
    inside the text, so the last windows may be pure overlap.  Rows without text give no
    chunks; a missing url reads as 'unknown'."""
    if size <= overlap:
        raise ValueError("chunk size must exceed the overlap (the step would not advance)")
    step = size - overlap
    d = docs.filter(F.col(text).isNotNull() & (F.length(text) > 0))
    url_col = F.coalesce(F.col(url), F.lit("unknown")) if url and url in docs.columns else F.lit("unknown")
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))
    return d.select(
        key, url_col.alias("url"),
        F.posexplode(F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, size).alias("text"))))
        .alias("chunk_no", "c"),
    ).select(key, "url", "chunk_no", F.col("c.start").alias("start"), F.col("c.text").alias("text"))


# -------------------------------------------------------- language
def _count_in(text_col, words):
    """Number of white-space separated tokens equal to one of ``words``: a token is a
    match not preceded or followed by a non-space character (one regex pass)."""
    import re
    nonspace = r"[^\s\x{1c}-\x{1f}]"
    alt = "|".join(re.escape(w) for w in words)
    rx = rf"(?U)(?<!{nonspace})(?:{alt})(?!{nonspace})"
    return F.size(F.regexp_extract_all(text_col, F.lit(rx), 0))


def lang_guess(docs: DataFrame, text: str = "text", target: str = "en") -> DataFrame:
    """Stop-word vote French vs German (winner must beat the other and exceed 5),
    else English; needs_translation when the guess is neither the target nor English."""
    low = F.lower(F.col(text))
    fr, de = _count_in(low, K.FRENCH_WORDS), _count_in(low, K.GERMAN_WORDS)
    d = docs.withColumn("fr_hits", fr).withColumn("de_hits", de)
    lang = (
        F.when((F.col("fr_hits") > F.col("de_hits")) & (F.col("fr_hits") > 5), "fr")
        .when((F.col("de_hits") > F.col("fr_hits")) & (F.col("de_hits") > 5), "de")
        .otherwise("en")
    )
    d = d.withColumn("detected_language", lang)
    return d.withColumn(
        "needs_translation", (F.col("detected_language") != target) & (F.col("detected_language") != "en")
    )


# ---------------------------------------------------------- repairs (C7a-c)
def repair_runs(c):
    """A run of more than two equal characters (case-insensitive): an ASCII letter
    keeps one, anything else keeps two (the run's first character, twice)."""
    c = F.regexp_replace(c, r"(?iu)([a-z])\1{2,}", "$1")
    return F.regexp_replace(c, r"(?isu)([^a-z])\1{2,}", "$1$1")


def repair_pairs(c):
    """A pair followed by itself (case-insensitive) is kept once, scanning left to right."""
    return F.regexp_replace(c, r"(?isu)(..)\1", "$1")


def repair_dict(c, pairs=K.REPAIR_REPLACEMENTS):
    """Literal replacements, in order."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def repair_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """The three passes; texts shorter than 2 characters pass unchanged, the pair pass
    needs at least 4 characters."""
    t = F.col(text)
    once = repair_runs(t)
    twice = F.when(F.length(once) >= 4, repair_pairs(once)).otherwise(once)
    fixed = repair_dict(twice)
    return docs.withColumn(text, F.when(t.isNull() | (F.length(t) < 2), t).otherwise(fixed))


# --------------------------------------------------- page text assembly
def doc_text(pages: DataFrame, key: str = "doc_id", page: str = "page_no", text: str = "text",
             sep: str = "\n\n") -> DataFrame:
    """Page texts joined in page order.  One output row per document."""
    agg = pages.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("ps")
    )
    return agg.select(key, F.array_join(F.transform("ps", lambda x: x["t"]), sep).alias("text"))


def _joined(pages, key, page, col, sep, skip_empty):
    t = F.coalesce(F.col(col), F.lit(""))
    ps = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), t.alias("t"))))
    if skip_empty:
        ps = F.filter(ps, lambda x: x["t"] != "")
    return F.array_join(F.transform(ps, lambda x: x["t"]), sep)


def text_first(pages: DataFrame, key: str = "doc_id", page: str = "page_no",
               cols=("text_a", "text_b", "text_c")) -> DataFrame:
    """Per document the first extractor whose joined text is not blank.  The first
    joins every page with '\\n', the others join only non-empty pages; when all are
    blank the last one is returned."""
    a, b, c = cols
    agg = pages.groupBy(key).agg(
        _joined(pages, key, page, a, "\n", False).alias("ta"),
        _joined(pages, key, page, b, "\n", True).alias("tb"),
        _joined(pages, key, page, c, "\n", True).alias("tc"),
    )
    nb = lambda x: pystrip(F.col(x)) != ""
    return agg.select(key, F.when(nb("ta"), F.col("ta")).when(nb("tb"), F.col("tb")).otherwise(F.col("tc")).alias("text"))


def text_all(pages: DataFrame, key: str = "doc_id", page: str = "page_no",
             cols=("text_a", "text_b", "text_c")) -> DataFrame:
    """Every extractor's pages, each followed by a blank line, concatenated; stripped."""
    parts = []
    for c in cols:
        t = F.coalesce(F.col(c), F.lit(""))
        ps = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.concat(t, F.lit("\n\n")).alias("t"))))
        parts.append(F.array_join(F.transform(ps, lambda x: x["t"]), ""))
    return pages.groupBy(key).agg(pystrip(F.concat(*parts)).alias("text"))


# ------------------------------------------------------------- tables
_TABLE = ["doc_id", "page_no", "table_no"]
#: The same with nulls replaced and flagged, so that neither reader of :func:`_dealt` filters its input.
_KEY = ["_doc_id", "_page_no", "_no_page", "_table_no", "_no_table"]
#: Rows of a table that are dealt together.
STRETCH = 1 << 16


def _dealt(cells: DataFrame) -> DataFrame:
    """The cells dealt by table and stretch of its rows: the one shuffle that heads and rows are read
    from, and no table is one group."""
    def known(c):
        return F.coalesce(F.col(c), F.lit("0").cast(cells.schema[c].dataType)).alias(f"_{c}")

    def missing(*cols):
        return sum(F.col(c).isNull().cast("int") * (i + 1) for i, c in enumerate(cols))

    # rows without a number stand in the last stretch
    stretch = F.coalesce(F.floor(F.col("row_no") / STRETCH), F.lit(1 << 62)).alias("_stretch")
    return cells.select(known("doc_id"), known("page_no"), missing("doc_id", "page_no").alias("_no_page"), known("table_no"),
                        missing("table_no").alias("_no_table"), stretch, "row_no", "col_no", "cell") \
        .repartition(*_KEY, "_stretch")


def _table_heads(dealt: DataFrame) -> DataFrame:
    """One row per table and stretch: ``whole`` (no part of the table's key is missing) and, of the whole
    table, first_row, n_cols, filled (cells that are neither null nor empty), ``head``, the cells of the
    first row as (col_no, cell), and table_number, its place in the page."""
    from pyspark.sql import Window
    per_col = dealt.groupBy(*_KEY, "_stretch", "col_no").agg(
        F.min("row_no").alias("row_no"), F.min_by(F.struct("cell"), "row_no").alias("top"),
        F.count_if(F.coalesce(F.col("cell") != "", F.lit(False))).alias("filled"))
    part = per_col.groupBy(*_KEY, "_stretch").agg(
        F.min("row_no").alias("first_row"), F.max("col_no").alias("last_col"), F.sum("filled").alias("filled"),
        F.max(F.col("_no_page") + F.col("_no_table")).alias("missing"),
        F.collect_list(F.struct("col_no", "row_no", F.col("top.cell").alias("cell"))).alias("cols"))
    page = Window.partitionBy(*_KEY[:3]).orderBy(F.desc("_no_table"), "_table_no")
    table = Window.partitionBy(*_KEY)
    tab = part.withColumn("table_number", F.dense_rank().over(page)).select(
        *_KEY, "_stretch", "table_number", (F.col("missing") == 0).alias("whole"), F.min("first_row").over(table).alias("first_row"),
        (F.max("last_col").over(table) + 1).alias("n_cols"), F.sum("filled").over(table).alias("filled"),
        F.min_by("cols", "_stretch").over(table).alias("cols"))
    return tab.withColumn("head", F.filter("cols", lambda c: c["row_no"] == F.col("first_row"))).drop("cols").filter("whole")


def _head_cell(head, col_no):
    """The struct of ``head`` at ``col_no``, null where the first row has no such cell."""
    return F.get(F.filter(head, lambda c: c["col_no"] == col_no), F.lit(0))


def table_header(cells: DataFrame) -> DataFrame:
    """Per table (doc, page, table) drop tables without any non-empty cell; when the
    first row has no null cell it becomes the header.  Output: one row per data cell with
    its column name (header text, else the column position).  A table's cells differ in (row, column)."""
    dealt = _dealt(cells)
    tab = _table_heads(dealt).filter(F.col("filled") > 0)
    named = F.size(F.filter("head", lambda c: c["cell"].isNotNull())) == F.col("n_cols")
    body = dealt.join(tab.select(*_KEY, "_stretch", "first_row", "head", named.alias("promoted")), [*_KEY, "_stretch"])
    body = body.filter(~(F.col("promoted") & (F.col("row_no") == F.col("first_row"))))
    name = F.when(F.col("promoted"), _head_cell(F.col("head"), F.col("col_no"))["cell"]) \
        .otherwise(F.col("col_no").cast("string"))
    return body.select(*(F.col(f"_{c}").alias(c) for c in _TABLE), "row_no", "col_no", name.alias("column_name"), "cell")


def table_rows(cells: DataFrame) -> DataFrame:
    """First row gives the headers (stripped text, blank or null -> 'Column{k}'); each
    later row maps header -> stripped cell ('' for a missing cell); cells beyond the header
    width are dropped.  Tables are numbered per page from 1 in table order."""
    dealt = _dealt(cells)
    tab = _table_heads(dealt).select(*_KEY, "_stretch", "first_row", "head", "table_number")
    # a plain comparison would ask for numbered rows below the shuffle, for this reader only
    later = F.coalesce(F.col("row_no") > F.col("first_row"), F.lit(False))
    body = dealt.join(tab, [*_KEY, "_stretch"]).filter(later)
    body = body.withColumn("top", _head_cell(F.col("head"), F.col("col_no"))).filter(F.col("top").isNotNull())

    def text_or(cell, other):
        return F.when(F.coalesce(cell, F.lit("")) != "", pystrip(cell)).otherwise(other)

    return body.select(
        F.col("_doc_id").alias("doc_id"), F.col("_page_no").alias("page"), "table_number", "row_no", "col_no",
        text_or(F.col("top.cell"), F.concat(F.lit("Column"), F.col("col_no").cast("string"))).alias("header"),
        text_or(F.col("cell"), F.lit("")).alias("value"))


def table_blocks(spans: DataFrame) -> DataFrame:
    """C11: text blocks with more than two lines whose lines all have the same span count,
    greater than one, are tables."""
    per_line = spans.groupBy("doc_id", "block_no", "line_no").agg(F.count(F.lit(1)).alias("n_spans"))
    return (
        per_line.groupBy("doc_id", "block_no")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.min("n_spans").alias("lo"), F.max("n_spans").alias("hi"))
        .filter((F.col("n_lines") > 2) & (F.col("lo") == F.col("hi")) & (F.col("lo") > 1))
        .select("doc_id", "block_no", "n_lines", F.col("lo").alias("n_columns"))
    )


# -------------------------------------------------------- classification
def menu_docs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Likely menu when >= 5 price kinds occur (4 exist, so never), or >= 2 section
    words occur as whole words, or >= 3 item-with-price matches.

    Every regex runs only on texts that contain its literal anchor (a cheap substring
    test), so long texts without prices or section words cost one scan each.
    """
    t = F.col(text)
    low = F.lower(t)
    has_dollar, has_euro = t.contains("$"), t.contains("€")
    anchors = {0: has_dollar, 1: has_euro, 2: t.contains("£"), 3: F.lit(True)}
    kinds = sum(F.when(anchors[i], t.rlike(p)).otherwise(False).cast("int")
                for i, p in enumerate(K.MENU_PRICE_KINDS))
    sections = sum(
        F.when(low.contains(w), low.rlike(r"(?U)\b" + w + r"\b")).otherwise(False).cast("int")
        for w in K.MENU_SECTION_WORDS
    )
    fmt_anchor = [has_dollar & t.contains("...."), has_dollar, has_euro]
    formats = sum(
        F.when(a, F.size(F.regexp_extract_all(t, F.lit("(?U)" + p), 0))).otherwise(0)
        for a, p in zip(fmt_anchor, K.MENU_ITEM_FORMATS)
    )
    d = docs.withColumn("price_kinds", kinds).withColumn("section_hits", sections).withColumn("format_hits", formats)
    return d.withColumn(
        "is_menu", (F.col("price_kinds") >= 5) | (F.col("section_hits") >= 2) | (F.col("format_hits") >= 3)
    )


# ------------------------------------------------------ context, metrics
def context(df: DataFrame, text: str, target: str, window: int = K.CONTEXT_WINDOW) -> DataFrame:
    """Text around the first occurrence of target, ``window`` characters each side;
    '' when absent."""
    pos = F.instr(F.col(text), F.col(target)) - 1
    start = F.greatest(pos - window, F.lit(0))
    end = F.least(F.length(text), pos + F.length(target) + window)
    ctx = F.when(pos < 0, F.lit("")).otherwise(F.substring(F.col(text), start + 1, end - start))
    return df.withColumn("context", ctx)


def text_metrics(docs: DataFrame, text: str = "text", tables: str | None = None) -> DataFrame:
    """C14/C17: words (white-space split), characters, success (text not empty), tables."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.size(F.filter(F.split(t, r"(?U)[\s\x{1c}-\x{1f}]+"), lambda w: w != ""))
    out = docs.withColumn("word_count", words).withColumn("character_count", F.length(t)) \
        .withColumn("extraction_success", t != "")
    return out.withColumn("num_tables", F.coalesce(F.col(tables), F.lit(0)) if tables else F.lit(0))


def doc_metadata(docs: DataFrame, meta: str = "metadata", keys=K.DOC_METADATA_KEYS) -> DataFrame:
    """Named metadata keys with '' for missing ones."""
    cols = [F.coalesce(F.element_at(F.col(meta), F.lit(src)), F.lit("")).alias(name) for name, src in keys]
    return docs.select(*[c for c in docs.columns if c != meta], *cols)


def pdf_metadata(docs: DataFrame, meta: str = "metadata", pages: str = "n_pages", keys=K.PDF_METADATA_KEYS) -> DataFrame:
    """C16, second form: four named keys with '' for missing ones and the page count; all null
    for a document without any metadata."""
    found = F.size(F.col(meta)) > 0
    cols = [F.when(found, F.coalesce(F.element_at(F.col(meta), F.lit(src)), F.lit(""))).alias(name) for name, src in keys]
    return docs.select(*[c for c in docs.columns if c not in (meta, pages)], *cols,
                       F.when(found, F.col(pages)).alias("page_count"))


# ------------------------------------------------------- match offsets and windows

def match_spans(df: DataFrame, key, text: str, patterns) -> DataFrame:
    """Every match of every pattern with its offsets: (key..., pattern_no, match_no,
    match, start, end), 0-based, patterns and matches in order.

    The text is cut at its matches; the pieces are
    exploded and a running sum of their lengths (one window per document) gives the
    offsets, so the cost stays linear in the document."""
    from pyspark.sql import Window
    keys = [key] if isinstance(key, str) else list(key)
    # one scan: every pattern's pieces side by side, then exploded
    per_pattern = F.array(*[
        F.struct(F.lit(i).alias("pattern_no"),
                 match_pieces(F.col(text), p).alias("pieces"))
        for i, p in enumerate(patterns)])
    e = df.select(*keys, F.explode(per_pattern).alias("pp")).select(
        *keys, F.col("pp.pattern_no").alias("pattern_no"), F.posexplode("pp.pieces").alias("i", "piece"))
    w = Window.partitionBy(*keys, "pattern_no").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0)))
    return e.filter(F.col("i") % 2 == 1).select(
        *keys, "pattern_no", ((F.col("i") - 1) / 2).cast("int").alias("match_no"), F.col("piece").alias("match"),
        F.col("start").cast("int").alias("start"), (F.col("start") + F.length("piece")).cast("int").alias("end"))


def span_windows(texts: DataFrame, key, text: str, spans: DataFrame, span_keys, lo: str, hi: str,
                 out: str, block: int = 4096) -> DataFrame:
    """Add ``out`` = text[lo:hi] to every span.  The text is cut into fixed blocks and each
    span joins only the blocks it overlaps, so a span never carries a whole document."""
    keys = [key] if isinstance(key, str) else list(key)
    n_blocks = F.greatest(F.ceil(F.length(text) / block).cast("int") - 1, F.lit(0))
    blocks = texts.select(*keys, F.posexplode(F.transform(
        F.sequence(F.lit(0), n_blocks), lambda b: F.substring(F.col(text), b * block + 1, block))).alias("block", "chunk"))
    need = spans.select(*span_keys, lo, hi, F.explode(F.sequence(
        F.floor(F.col(lo) / block).cast("int"),
        F.floor(F.greatest(F.col(hi) - 1, F.col(lo)) / block).cast("int"))).alias("block"))
    j = need.join(blocks, [*keys, "block"])
    agg = j.groupBy(*span_keys, lo, hi).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "chunk"))), lambda x: x["chunk"]), "")
        .alias("_joined"), F.min("block").alias("_b0"))
    win = F.when(F.col(hi) > F.col(lo),
                 F.substring("_joined", F.col(lo) - F.col("_b0") * block + 1, F.col(hi) - F.col(lo))).otherwise(F.lit(""))
    got = agg.select(*span_keys, win.alias(out))
    return spans.join(got, span_keys, "left").withColumn(out, F.coalesce(F.col(out), F.lit("")))
