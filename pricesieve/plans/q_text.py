"""Registered queries for text preparation and menu extraction."""
from __future__ import annotations

from pricesieve.operators import menu, text
from pricesieve.plans.fixtures import fixture
from pricesieve.plans.registry import SQL, register

# Shared oracle fragment: numbered, stripped lines of a text table.
def _lines_sql(src: str, key: str = "doc_id") -> str:
    return f"""(SELECT {key}, i - 1 AS line_no,
        regexp_replace(parts[i], '^\\s+|\\s+$', '', 'g') AS line
     FROM (SELECT {key}, string_split(text, chr(10)) AS parts FROM {src}) s,
          generate_series(1, len(parts)) AS g(i))"""


@register("lines", ["fx_listing_text"], f"""
SELECT doc_id, line_no, line FROM {_lines_sql('fx_listing_text')} l WHERE line <> ''""")
def q_lines(spark, sf):
    return text.lines(fixture(spark, sf, "fx_listing_text"))


@register("menu_line_end", ["fx_listing_text"], f"""
SELECT doc_id, line_no, item, price, '$' AS currency FROM (
  SELECT doc_id, line_no,
         regexp_replace(regexp_replace(regexp_extract(line, '^(.*?)(\\d{{1,2}}\\.\\d{{2}})$', 1),
                        '^\\s+|\\s+$', '', 'g'), '[\\s.]+$', '') AS item,
         regexp_extract(line, '^(.*?)(\\d{{1,2}}\\.\\d{{2}})$', 2) AS price
  FROM {_lines_sql('fx_listing_text')} l WHERE line <> '') x
WHERE price <> '' AND length(item) > 3""")
def q_menu_line_end(spark, sf):
    return menu.menu_line_end(fixture(spark, sf, "fx_listing_text"))


# ------------------------------------------------------------ price lines
from pricesieve import constants as K  # noqa: E402
from pricesieve.plans import sqlfrag as S  # noqa: E402


def _raw_lines_sql() -> str:
    return f"""(SELECT doc_id, i - 1 AS line_no, parts[i] AS raw,
        CASE WHEN i > 1 THEN {S.strip('parts[i - 1]')} END AS prev,
        CASE WHEN i < len(parts) THEN {S.strip('parts[i + 1]')} END AS next
     FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM fx_listing_text) s,
          generate_series(1, len(parts)) AS g(i))"""


def _prices_sql() -> str:
    parts = []
    for i, p in enumerate(K.PRICE_PATTERNS):
        pieces = f"string_split(regexp_replace(raw, {S.q(S.re2(p))}, chr(1) || '\\0' || chr(1), 'g'), chr(1))"
        parts.append(f"""SELECT doc_id, line_no, prev, next, {i} AS pattern_no, k AS match_no, pieces[2 * k] AS price,
       array_to_string(pieces[1:2 * k - 1], '') AS before, array_to_string(pieces[2 * k + 1:], '') AS after
FROM (SELECT *, {pieces} AS pieces FROM {_raw_lines_sql()} l) x,
     generate_series(1, CAST(floor((len(pieces) - 1) / 2) AS BIGINT)) AS g(k)""")
    return "(" + "\nUNION ALL ".join(parts) + ")"


@register("prices", ["fx_listing_text"], f"SELECT * FROM {_prices_sql()} p")
def q_prices(spark, sf):
    return menu.prices(fixture(spark, sf, "fx_listing_text"))


_NAME = f"""{S.strip(f"regexp_replace(CASE WHEN coalesce(pre, '') <> '' THEN pre ELSE post END, '^[0-9.{S.WS[1:-1]}]+', '')")}"""


@register("line_items", ["fx_listing_text"], f"""
SELECT doc_id, line_no, pattern_no, match_no, product_name, price, 'Extracted from PDF' AS category,
       'PDF Extractor' AS extracted_by FROM (
  SELECT *, {_NAME} AS product_name FROM (
    SELECT *, CASE WHEN {S.strip('before')} <> '' THEN {S.strip('before')} ELSE coalesce(prev, '') END AS pre,
              CASE WHEN {S.strip('after')} <> '' THEN {S.strip('after')} ELSE coalesce(next, '') END AS post
    FROM {_prices_sql()} p) a) b
WHERE length(product_name) > 3""")
def q_line_items(spark, sf):
    return menu.line_items(fixture(spark, sf, "fx_listing_text"))


@register("menu_sections", ["fx_listing_text"], f"""
WITH h AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, {S.q(K.SECTION_HEADER_PATTERN)}, 1)) AS h
           FROM fx_listing_text),
l AS (SELECT doc_id, i - 1 AS line_no, parts[i] AS raw
      FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM fx_listing_text) s,
           generate_series(1, len(parts)) AS g(i)),
hl AS (SELECT DISTINCT l.doc_id, l.line_no FROM l JOIN h ON l.doc_id = h.doc_id AND instr(l.raw, h.h) > 0),
m AS (SELECT l.*, hl.line_no IS NOT NULL AS is_header FROM l LEFT JOIN hl ON l.doc_id = hl.doc_id AND l.line_no = hl.line_no),
c AS (SELECT *, coalesce(last_value(CASE WHEN is_header THEN {S.strip('raw')} END IGNORE NULLS)
                 OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 'General Menu') AS category,
             regexp_extract(raw, {S.q(S.re2(K.SECTION_PRICE_PATTERN))}, 1) AS price FROM m),
n AS (SELECT *, {S.strip("split_part(raw, price, 1)")} AS nm FROM c WHERE NOT is_header AND price <> '')
SELECT doc_id, line_no, regexp_replace(nm, '^[0-9.{S.WS[1:-1]}]+', '') AS product_name, price, category
FROM n WHERE nm <> ''""")
def q_menu_sections(spark, sf):
    return menu.menu_sections(fixture(spark, sf, "fx_listing_text"))


def _pat_sql() -> str:
    parts = []
    for i, p in enumerate(K.MENU_ITEM_PATTERNS):
        parts.append(f"list_transform(list_zip(regexp_extract_all(text, {S.q(S.re2(p))}, 1), "
                     f"regexp_extract_all(text, {S.q(S.re2(p))}, 2)), lambda x: {{'pattern_no': {i}, "
                     f"'item': x[1], 'price': x[2]}})")
    allp = parts[0]
    for p in parts[1:]:
        allp = f"list_concat({allp}, {p})"
    return allp


@register("menu_patterns", ["fx_listing_text"], f"""
SELECT doc_id, pos, pattern_no, item, price, '$' AS currency FROM (
  SELECT doc_id, i - 1 AS pos, f[i].pattern_no AS pattern_no, {S.strip('f[i].item')} AS item,
         replace({S.strip('f[i].price')}, ',', '.') AS price
  FROM (SELECT doc_id, {_pat_sql()} AS f FROM fx_listing_text) s, generate_series(1, len(f)) AS g(i)) x
WHERE length(item) >= 3""")
def q_menu_patterns(spark, sf):
    return menu.menu_patterns(fixture(spark, sf, "fx_listing_text"))


def _menu_lines_sql() -> str:
    alt = "|".join(p[1:-1] for p in K.PRICE_PATTERNS)
    rx = S.q(S.re2(K.MENU_LINE_NAME + "(" + alt + ")"))
    return f"""(SELECT doc_id, line_no, match_no, product_name, price, 'Menu Item' AS category,
        'PDF Menu Extractor' AS extracted_by FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, product_name, price ORDER BY line_no, match_no) AS rn FROM (
    SELECT doc_id, line_no, k - 1 AS match_no, {S.strip('n[k]')} AS product_name, p[k] AS price
    FROM (SELECT doc_id, line_no, regexp_extract_all(raw, {rx}, 1) AS n, regexp_extract_all(raw, {rx}, 2) AS p
          FROM {_raw_lines_sql()} l) x, generate_series(1, len(n)) AS g(k)) y) z
 WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM ({_LINE_ITEMS}) li
                              WHERE li.doc_id = z.doc_id AND li.product_name = z.product_name AND li.price = z.price))"""


_LINE_ITEMS = f"""
SELECT doc_id, line_no, pattern_no, match_no, product_name, price, 'Extracted from PDF' AS category,
       'PDF Extractor' AS extracted_by FROM (
  SELECT *, {_NAME} AS product_name FROM (
    SELECT *, CASE WHEN {S.strip('before')} <> '' THEN {S.strip('before')} ELSE coalesce(prev, '') END AS pre,
              CASE WHEN {S.strip('after')} <> '' THEN {S.strip('after')} ELSE coalesce(next, '') END AS post
    FROM {_prices_sql()} p) a) b
WHERE length(product_name) > 3"""


@register("menu_lines", ["fx_listing_text"], f"SELECT * FROM {_menu_lines_sql()} m")
def q_menu_lines(spark, sf):
    return menu.menu_lines(fixture(spark, sf, "fx_listing_text"))


_SPLITLINES = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def _currency_sql() -> str:
    parts = []
    for i, p in enumerate(K.CURRENCY_PATTERNS):
        pieces = f"string_split(regexp_replace(raw, {S.q(S.re2(p))}, chr(1) || '\\0' || chr(1), 'g'), chr(1))"
        parts.append(f"""SELECT doc_id, line_no, {i} AS pattern_no, k AS match_no,
       {S.strip("array_to_string(pieces[1:2 * k - 1], '')")} AS item,
       regexp_extract(pieces[2 * k], {S.q('^' + S.re2(p))}, 1) AS price,
       CASE WHEN contains(raw, '€') THEN '€' WHEN contains(raw, '$') THEN '$' WHEN contains(raw, '£') THEN '£'
            ELSE '' END AS currency
FROM (SELECT *, {pieces} AS pieces FROM (
        SELECT doc_id, i - 1 AS line_no, parts[i] AS raw
        FROM (SELECT doc_id, string_split_regex(text, '{_SPLITLINES}') AS parts FROM fx_listing_text) s,
             generate_series(1, len(parts)) AS g(i)) l
      WHERE length({S.strip('raw')}) >= 5) x,
     generate_series(1, CAST(floor((len(pieces) - 1) / 2) AS BIGINT)) AS g(k)""")
    return "(" + "\nUNION ALL ".join(parts) + ")"


@register("menu_currency", ["fx_listing_text"], f"SELECT * FROM {_currency_sql()} c WHERE length(item) > 3")
def q_menu_currency(spark, sf):
    return menu.menu_currency(fixture(spark, sf, "fx_listing_text"))


_NAME_LIST = f"""(SELECT doc_id, line_no, item, '0.00' AS price, '$' AS currency FROM (
  SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM (
    SELECT doc_id, line_no, regexp_extract(line, '^([A-Za-z]+)\\s*(\\d+(?:\\.\\d+)*)?', 1) AS item
    FROM {S.lines_of('fx_listing_text')} l WHERE line <> '' AND NOT contains(line, 'Add to basket')) a
  WHERE length(item) > 3) b WHERE n > 3)"""


@register("name_list", ["fx_listing_text"], f"SELECT * FROM {_NAME_LIST} n")
def q_name_list(spark, sf):
    return menu.name_list(fixture(spark, sf, "fx_listing_text"))


_D7 = f"""(SELECT doc_id, line_no, item, price, '$' AS currency FROM (
  SELECT doc_id, line_no,
         regexp_replace({S.strip("regexp_extract(line, '^(.*?)(\\d{1,2}\\.\\d{2})$', 1)")}, '[\\s.]+$', '') AS item,
         regexp_extract(line, '^(.*?)(\\d{{1,2}}\\.\\d{{2}})$', 2) AS price
  FROM {S.lines_of('fx_listing_text')} l WHERE line <> '') x WHERE price <> '' AND length(item) > 3)"""


def _menu_pat_items() -> str:
    return f"""(SELECT doc_id, pos, item, price, '$' AS currency FROM (
  SELECT doc_id, i - 1 AS pos, {S.strip('f[i].item')} AS item, replace({S.strip('f[i].price')}, ',', '.') AS price
  FROM (SELECT doc_id, {_pat_sql()} AS f FROM fx_listing_text) s, generate_series(1, len(f)) AS g(i)) x
 WHERE length(item) >= 3)"""


@register("menu_items", ["fx_listing_text"], f"""
WITH d7 AS (SELECT doc_id, 0 AS src, line_no AS seq, item, price, currency FROM {_D7} a),
fb AS (SELECT doc_id, 1 AS src, pos AS seq, item, price, currency FROM {_menu_pat_items()} b
       WHERE doc_id NOT IN (SELECT doc_id FROM d7)
       UNION ALL
       SELECT doc_id, 2, line_no, item, price, currency FROM {_NAME_LIST} c WHERE doc_id NOT IN (SELECT doc_id FROM d7)),
fd AS (SELECT * EXCLUDE (rn) FROM (
         SELECT *, row_number() OVER (PARTITION BY doc_id, lower(item) ORDER BY src, seq) AS rn FROM fb
         WHERE NOT contains(lower(item), 'add to basket')) x WHERE rn = 1)
SELECT * FROM d7 UNION ALL SELECT * FROM fd""")
def q_menu_items(spark, sf):
    return menu.menu_items(fixture(spark, sf, "fx_listing_text"))


@register("pdf_products", ["fx_listing_text"], f"""
SELECT doc_id, line_no, product_name, price, category, extracted_by FROM ({_LINE_ITEMS}) a
UNION ALL SELECT doc_id, line_no, product_name, price, category, extracted_by FROM {_menu_lines_sql()} b""")
def q_pdf_products(spark, sf):
    return menu.pdf_products(fixture(spark, sf, "fx_listing_text"))


def _desc_start_sql() -> str:
    out = "NULL"
    for p in reversed(K.PRICE_PATTERNS):
        rp = S.q(S.re2(p))
        before = f"regexp_extract(line, {S.q('^(.*?)' + S.re2(p))}, 1)"
        name = S.strip(f"regexp_replace({S.strip(before)}, '^[0-9.{S.WS[1:-1]}]+', '')")
        out = (f"CASE WHEN regexp_matches(line, {rp}) AND length({name}) > 3 "
               f"THEN {{'n': {name}, 'p': regexp_extract(line, {rp}, 1)}} ELSE {out} END")
    return out


def _has_price_sql() -> str:
    return "(" + " OR ".join(f"regexp_matches(line, {S.q(S.re2(p))})" for p in K.PRICE_PATTERNS) + ")"


@register("descriptions", ["fx_listing_text"], f"""
WITH l AS (SELECT doc_id, line_no, line, line = '' AS blank, {_has_price_sql()} AS has_price, {_desc_start_sql()} AS st
           FROM {S.lines_of('fx_listing_text')} x),
b AS (SELECT *, sum(CASE WHEN st IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block,
             NOT blank AND NOT has_price AS is_text FROM l),
t AS (SELECT *, coalesce(sum(CASE WHEN is_text THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, block ORDER BY line_no
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS text_before FROM b),
c AS (SELECT *, coalesce(max(CASE WHEN blank AND text_before > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, block
                 ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS closed FROM t),
blocks AS (SELECT doc_id, block, line_no AS block_line, st.n AS product_name, st.p AS price FROM c WHERE st IS NOT NULL),
texts AS (SELECT doc_id, block, string_agg(line, ' ' ORDER BY line_no) AS description FROM c
          WHERE is_text AND block > 0 AND NOT closed GROUP BY ALL),
bb AS (SELECT blocks.*, texts.description FROM blocks LEFT JOIN texts USING (doc_id, block)),
pn AS (SELECT doc_id, product_name,
              arg_max(description, block_line) FILTER (WHERE description IS NOT NULL) AS description,
              arg_min(price, block_line) AS price FROM bb GROUP BY ALL),
old AS (SELECT DISTINCT doc_id, product_name FROM ({_LINE_ITEMS}) a
        UNION SELECT DISTINCT doc_id, product_name FROM {_menu_lines_sql()} m)
SELECT pn.doc_id, pn.product_name, pn.description, old.doc_id IS NULL AS is_new,
       CASE WHEN old.doc_id IS NULL THEN pn.price END AS price
FROM pn LEFT JOIN old ON pn.doc_id = old.doc_id AND pn.product_name = old.product_name""")
def q_descriptions(spark, sf):
    return menu.descriptions(fixture(spark, sf, "fx_listing_text"))


def _on_menus(sql: str) -> str:
    return sql.replace("fx_listing_text", "fx_menu_text")


def _menu_test_sql() -> str:
    from pricesieve.plans.q_textprep import is_menu_sql
    return f"(SELECT doc_id FROM fx_menu_text WHERE {is_menu_sql()})"


@register("menu_merge", ["fx_menu_text"], f"""
WITH p1 AS ({_on_menus(_LINE_ITEMS)}), p2 AS (SELECT * FROM {_on_menus(_menu_lines_sql())} m),
p3 AS ({_on_menus(SQL['descriptions'])}), sections AS ({_on_menus(SQL['menu_sections'])}),
e AS (SELECT doc_id, 1 AS pass, line_no, pattern_no, match_no, product_name, price, category, extracted_by FROM p1
      UNION ALL SELECT doc_id, 2, line_no, 0, match_no, product_name, price, category, extracted_by FROM p2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, product_name ORDER BY pass, line_no, pattern_no, match_no) AS rn FROM e),
prods AS (SELECT r.* EXCLUDE (rn), CASE WHEN rn = 1 THEN p3.description END AS description
          FROM r LEFT JOIN p3 ON r.doc_id = p3.doc_id AND r.product_name = p3.product_name AND NOT p3.is_new
          UNION ALL
          SELECT doc_id, 3, NULL, NULL, NULL, product_name, price, 'Menu Item', 'PDF Menu Extractor', description
          FROM p3 WHERE is_new)
SELECT * FROM prods
UNION ALL
SELECT doc_id, 4, line_no, NULL, NULL, product_name, price, category, NULL, NULL FROM sections
WHERE doc_id IN {_menu_test_sql()} AND doc_id NOT IN (SELECT doc_id FROM prods)""")
def q_menu_merge(spark, sf):
    """All products of menu documents, sectioned items merged by absent name."""
    return menu.document_products(fixture(spark, sf, "fx_menu_text"))


@register("pdf_products_menu", ["fx_menu_text"], f"""
WITH p AS ({_on_menus(SQL['pdf_products'])}), sections AS ({_on_menus(SQL['menu_sections'])})
SELECT * FROM p
UNION ALL SELECT doc_id, line_no, product_name, price, category, NULL FROM sections
WHERE doc_id IN {_menu_test_sql()} AND doc_id NOT IN (SELECT doc_id FROM p)""")
def q_pdf_products_menu(spark, sf):
    """Products, or the sectioned items of likely menus without any."""
    return menu.pdf_products(fixture(spark, sf, "fx_menu_text"))
