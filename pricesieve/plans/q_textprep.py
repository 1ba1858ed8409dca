"""Registered queries for text preparation (group C) on pages, documents and fixtures."""
from __future__ import annotations

from pyspark.sql import functions as F

from pricesieve import constants as K
from pricesieve.operators import text
from pricesieve.plans import sqlfrag as S
from pricesieve.plans.fixtures import fixture
from pricesieve.plans.registry import SQL, register
from pricesieve.sources.tables import read_table


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


@register("html_text", [], f"SELECT page_id, url, {S.html_text('html')} AS content FROM pages")
def q_html_text(spark, sf):
    return text.html_text(read_table(spark, sf, "pages"))


@register("html_blocks", [], f"SELECT page_id, url, {S.html_blocks('html')} AS text FROM pages")
def q_html_blocks(spark, sf):
    return text.html_blocks(read_table(spark, sf, "pages"))


@register("chunks", [], f"""
SELECT doc_id, coalesce(url, 'unknown') AS url, s // 300 AS chunk_no, s AS start, substring(text, s + 1, 500) AS text
FROM (SELECT doc_id, text, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE source END AS url
      FROM documents WHERE text IS NOT NULL AND length(text) > 0) d,
     generate_series(0, length(text) - 1, 300) AS g(s)""")
def q_chunks(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text", F.when(F.col("doc_id") % 10 == 0, None).otherwise(F.col("source")).alias("url"))
    return text.chunks(d, size=K.UI_CHUNK_SIZE, overlap=K.CHUNK_OVERLAP)


def _list(words):
    return "[" + ", ".join(S.q(w) for w in words) + "]"


_WORDS = f"regexp_split_to_array(lower(text), '{S.WS}+')"


@register("lang_guess", [], f"""
WITH c AS (
  SELECT doc_id, text, lang, source, n_chars,
         len(list_filter({_WORDS}, lambda x: list_contains({_list(K.FRENCH_WORDS)}, x))) AS fr_hits,
         len(list_filter({_WORDS}, lambda x: list_contains({_list(K.GERMAN_WORDS)}, x))) AS de_hits
  FROM documents)
SELECT *, detected_language <> 'en' AND detected_language <> 'en' AS needs_translation FROM (
  SELECT *, CASE WHEN fr_hits > de_hits AND fr_hits > 5 THEN 'fr'
                 WHEN de_hits > fr_hits AND de_hits > 5 THEN 'de' ELSE 'en' END AS detected_language FROM c) x""")
def q_lang_guess(spark, sf):
    return text.lang_guess(_docs(spark, sf), target="en")


def _repair_dict_sql(x):
    for old, new in K.REPAIR_REPLACEMENTS:
        x = f"replace({x}, {S.q(old)}, {S.q(new)})"
    return x


@register("repair_dict", [], f"SELECT doc_id, {_repair_dict_sql('text')} AS text FROM documents")
def q_repair_dict(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", text.repair_dict(F.col("text")).alias("text"))


_LETTERS = "[" + ", ".join(f"'{c}'" for c in "abcdefghijklmnopqrstuvwxyz") + "]"


@register("repair_runs", [], f"""
WITH c AS (SELECT doc_id, i, substring(text, i, 1) AS ch FROM documents, generate_series(1, length(text)) AS g(i)),
p AS (SELECT *, lag(ch) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM c),
r AS (SELECT *, sum(CASE WHEN prev IS NULL OR lower(ch) <> lower(prev) THEN 1 ELSE 0 END)
                  OVER (PARTITION BY doc_id ORDER BY i) AS run FROM p),
g AS (SELECT doc_id, run, count(*) AS n, string_agg(ch, '' ORDER BY i) AS s, arg_min(ch, i) AS f FROM r GROUP BY ALL),
t AS (SELECT doc_id, string_agg(CASE WHEN n > 2 THEN CASE WHEN list_contains({_LETTERS}, lower(f)) THEN f ELSE f || f END
                                     ELSE s END, '' ORDER BY run) AS text FROM g GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id""")
def q_repair_runs(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", text.repair_runs(F.col("text")).alias("text"))


def _pairs_ctes(src: str) -> str:
    """CTEs to ``fixed`` (doc_id, text): the left-to-right scan over ``src`` (doc_id, text).  A
    candidate is the start of four characters whose halves are equal; a kept one hides those that
    begin in the three characters after it."""
    return f"""
ch AS (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i
       FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS cs FROM {src}) t),
quad AS (SELECT doc_id, i, lower(c) = lower(lead(c, 2) OVER w) AND lower(lead(c, 1) OVER w) = lower(lead(c, 3) OVER w) AS hit
         FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
cand AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) >= 4, true) AS head FROM quad WHERE hit),
isl AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM cand),
nxt AS (SELECT a.doc_id, a.i, a.head, b.i AS following FROM isl a ASOF LEFT JOIN (SELECT *, i - 4 AS after FROM isl) b
        ON a.doc_id = b.doc_id AND a.island = b.island AND a.i <= b.after),
kept AS (SELECT doc_id, i, following FROM nxt WHERE head
         UNION ALL
         SELECT n.doc_id, n.i, n.following FROM kept k JOIN nxt n ON n.doc_id = k.doc_id AND n.i = k.following),
gone AS (SELECT doc_id, i + 2 AS i FROM kept UNION ALL SELECT doc_id, i + 3 FROM kept),
left_ch AS (SELECT doc_id, string_agg(c, '' ORDER BY i) AS text FROM ch ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
fixed AS (SELECT s.doc_id, CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(l.text, '') END AS text
          FROM {src} s LEFT JOIN left_ch l ON s.doc_id = l.doc_id)"""


@register("repair_pairs", [], f"WITH RECURSIVE {_pairs_ctes('documents')} SELECT * FROM fixed")
def q_repair_pairs(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", text.repair_pairs(F.col("text")).alias("text"))


@register("repair_text", [], f"""
WITH RECURSIVE once AS ({SQL['repair_runs']}),{_pairs_ctes('once')}
SELECT d.doc_id, CASE WHEN d.text IS NULL OR length(d.text) < 2 THEN d.text
                      ELSE {_repair_dict_sql("(CASE WHEN length(o.text) >= 4 THEN f.text ELSE o.text END)")} END AS text
FROM documents d LEFT JOIN once o ON d.doc_id = o.doc_id LEFT JOIN fixed f ON d.doc_id = f.doc_id""")
def q_repair_text(spark, sf):
    return text.repair_text(_docs(spark, sf).select("doc_id", "text"))


@register("doc_text", ["fx_doc_pages"], """
SELECT doc_id, string_agg(coalesce(text_c, ''), chr(10) || chr(10) ORDER BY page_no) AS text
FROM fx_doc_pages GROUP BY doc_id""")
def q_doc_text(spark, sf):
    return text.doc_text(fixture(spark, sf, "fx_doc_pages"), text="text_c")


@register("text_first", ["fx_doc_pages"], f"""
WITH j AS (
  SELECT doc_id,
         string_agg(coalesce(text_a, ''), chr(10) ORDER BY page_no) AS ta,
         coalesce(string_agg(text_b, chr(10) ORDER BY page_no) FILTER (WHERE coalesce(text_b, '') <> ''), '') AS tb,
         coalesce(string_agg(text_c, chr(10) ORDER BY page_no) FILTER (WHERE coalesce(text_c, '') <> ''), '') AS tc
  FROM fx_doc_pages GROUP BY doc_id)
SELECT doc_id, CASE WHEN {S.strip('ta')} <> '' THEN ta WHEN {S.strip('tb')} <> '' THEN tb ELSE tc END AS text FROM j""")
def q_text_first(spark, sf):
    return text.text_first(fixture(spark, sf, "fx_doc_pages"))


@register("text_all", ["fx_doc_pages"], f"""
SELECT doc_id, {S.strip('''string_agg(coalesce(text_a, '') || chr(10) || chr(10), '' ORDER BY page_no)
  || string_agg(coalesce(text_b, '') || chr(10) || chr(10), '' ORDER BY page_no)
  || string_agg(coalesce(text_c, '') || chr(10) || chr(10), '' ORDER BY page_no)''')} AS text
FROM fx_doc_pages GROUP BY doc_id""")
def q_text_all(spark, sf):
    return text.text_all(fixture(spark, sf, "fx_doc_pages"))


@register("table_header", ["fx_cells"], """
WITH st AS (
  SELECT doc_id, page_no, table_no, max(col_no) + 1 AS n_cols, min(row_no) AS first_row
  FROM fx_cells GROUP BY ALL HAVING count_if(coalesce(cell <> '', false)) > 0),
hd AS (
  SELECT c.doc_id, c.page_no, c.table_no, count(c.cell) AS n_hdr
  FROM fx_cells c JOIN st USING (doc_id, page_no, table_no) WHERE c.row_no = st.first_row GROUP BY ALL),
tb AS (SELECT st.*, coalesce(n_hdr, 0) = n_cols AS promoted FROM st LEFT JOIN hd USING (doc_id, page_no, table_no)),
nm AS (SELECT c.doc_id, c.page_no, c.table_no, c.col_no, c.cell AS column_name
       FROM fx_cells c JOIN st USING (doc_id, page_no, table_no) WHERE c.row_no = st.first_row)
SELECT c.doc_id, c.page_no, c.table_no, c.row_no, c.col_no,
       CASE WHEN tb.promoted THEN nm.column_name ELSE CAST(c.col_no AS VARCHAR) END AS column_name, c.cell
FROM fx_cells c JOIN tb USING (doc_id, page_no, table_no)
LEFT JOIN nm USING (doc_id, page_no, table_no, col_no)
WHERE NOT (tb.promoted AND c.row_no = tb.first_row)""")
def q_table_header(spark, sf):
    return text.table_header(fixture(spark, sf, "fx_cells"))


@register("table_rows", ["fx_cells"], f"""
WITH fr AS (SELECT doc_id, page_no, table_no, min(row_no) AS first_row FROM fx_cells GROUP BY ALL),
hd AS (
  SELECT c.doc_id, c.page_no, c.table_no, c.col_no,
         CASE WHEN coalesce(c.cell, '') <> '' THEN {S.strip('c.cell')} ELSE 'Column' || CAST(c.col_no AS VARCHAR) END AS header
  FROM fx_cells c JOIN fr USING (doc_id, page_no, table_no) WHERE c.row_no = fr.first_row),
num AS (SELECT doc_id, page_no, table_no,
               row_number() OVER (PARTITION BY doc_id, page_no ORDER BY table_no) AS table_number FROM fr)
SELECT c.doc_id, c.page_no AS page, num.table_number, c.row_no, c.col_no, hd.header,
       CASE WHEN coalesce(c.cell, '') <> '' THEN {S.strip('c.cell')} ELSE '' END AS value
FROM fx_cells c JOIN fr USING (doc_id, page_no, table_no)
JOIN hd USING (doc_id, page_no, table_no, col_no)
JOIN num USING (doc_id, page_no, table_no)
WHERE c.row_no > fr.first_row""")
def q_table_rows(spark, sf):
    return text.table_rows(fixture(spark, sf, "fx_cells"))


@register("table_blocks", ["fx_spans"], """
WITH pl AS (SELECT doc_id, block_no, line_no, count(*) AS n_spans FROM fx_spans GROUP BY ALL)
SELECT doc_id, block_no, count(*) AS n_lines, min(n_spans) AS n_columns FROM pl GROUP BY ALL
HAVING count(*) > 2 AND min(n_spans) = max(n_spans) AND min(n_spans) > 1""")
def q_table_blocks(spark, sf):
    return text.table_blocks(fixture(spark, sf, "fx_spans"))


def _menu_docs_src() -> str:
    return "(SELECT 'listing:' || doc_id AS doc_id, text FROM fx_listing_text UNION ALL SELECT 'document:' || doc_id, text FROM documents)"


_B0, _B1 = r"(?:^|[^\pL\pN_])", r"(?:$|[^\pL\pN_])"


def _menu_counts_sql() -> list[str]:
    """Price kinds, section words and item formats found in ``text``."""
    kinds = " + ".join(f"CAST(regexp_matches(text, {S.q(S.re2(p))}) AS INTEGER)" for p in K.MENU_PRICE_KINDS)
    words = " + ".join(f"CAST(regexp_matches(lower(text), {S.q(_B0 + w + _B1)}) AS INTEGER)" for w in K.MENU_SECTION_WORDS)
    formats = " + ".join(f"len(regexp_extract_all(text, {S.q(S.re2(p))}))" for p in K.MENU_ITEM_FORMATS)
    return [kinds, words, formats]


def is_menu_sql() -> str:
    kinds, words, formats = _menu_counts_sql()
    return f"({kinds} >= 5 OR {words} >= 2 OR {formats} >= 3)"


@register("menu_docs", ["fx_listing_text"], f"""
SELECT *, price_kinds >= 5 OR section_hits >= 2 OR format_hits >= 3 AS is_menu FROM (
  SELECT doc_id, text, {_menu_counts_sql()[0]} AS price_kinds, {_menu_counts_sql()[1]} AS section_hits,
         {_menu_counts_sql()[2]} AS format_hits
  FROM {_menu_docs_src()} d) x""")
def q_menu_docs(spark, sf):
    def of(source, df):
        return df.select(F.concat(F.lit(source + ":"), F.col("doc_id").cast("string")).alias("doc_id"), "text")

    lt, d = of("listing", fixture(spark, sf, "fx_listing_text")), of("document", _docs(spark, sf))
    return text.menu_docs(lt.unionByName(d))


@register("context", [], """
SELECT doc_id, target, CASE WHEN instr(text, target) = 0 THEN '' ELSE
         substring(text, greatest(instr(text, target) - 1 - 50, 0) + 1,
                   least(length(text), instr(text, target) - 1 + length(target) + 50)
                   - greatest(instr(text, target) - 1 - 50, 0)) END AS context
FROM (SELECT doc_id, text, split_part(text, ' ', 3) AS target FROM documents) d""")
def q_context(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text", F.split_part("text", F.lit(" "), F.lit(3)).alias("target"))
    return text.context(d, "text", "target").drop("text")


@register("text_metrics", [], f"""
SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{S.WS}+'), lambda w: w <> '')) AS word_count,
       length(coalesce(text, '')) AS character_count, coalesce(text, '') <> '' AS extraction_success, 0 AS num_tables
FROM documents""")
def q_text_metrics(spark, sf):
    return text.text_metrics(_docs(spark, sf).select("doc_id", "text")).drop("text")


@register("doc_metadata", ["fx_doc_meta"], f"""
SELECT doc_id, {', '.join(f"coalesce(metadata[{S.q(src)}], '') AS {name}" for name, src in K.DOC_METADATA_KEYS)}
FROM fx_doc_meta""")
def q_doc_metadata(spark, sf):
    return text.doc_metadata(fixture(spark, sf, "fx_doc_meta"))


@register("pdf_metadata", ["fx_pdf_meta"], f"""
SELECT doc_id, {', '.join(f"CASE WHEN len(map_keys(metadata)) > 0 THEN coalesce(metadata[{S.q(src)}], '') END AS {name}" for name, src in K.PDF_METADATA_KEYS)},
       CASE WHEN len(map_keys(metadata)) > 0 THEN n_pages END AS page_count
FROM fx_pdf_meta""")
def q_pdf_metadata(spark, sf):
    return text.pdf_metadata(fixture(spark, sf, "fx_pdf_meta"))
