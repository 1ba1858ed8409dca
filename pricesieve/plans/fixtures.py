"""Derived input views, stated once in SQL that Spark and DuckDB both run.

Each fixture stands for a record shape of the original application and is derived from
the stored tables, so it grows with them.  Spark registers the fixtures as temporary
views; the oracle receives the same text as common table expressions.  The only
dialect differences (ordered string aggregation) go through :class:`Dialect`.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pricesieve.sources.tables import register_tables


@dataclass(frozen=True)
class Dialect:
    name: str  # "spark" or "duckdb"

    def agg(self, expr: str, sep: str, order: str) -> str:
        """Ordered string aggregation."""
        if self.name == "spark":
            return f"listagg({expr}, {sep}) WITHIN GROUP (ORDER BY {order})"
        return f"string_agg({expr}, {sep} ORDER BY {order})"

    def series(self, table: str, upto: str, alias: str = "i") -> str:
        """FROM clause: each row of ``table`` with ``alias`` running 0..upto (lateral)."""
        if self.name == "spark":
            return f"{table} LATERAL VIEW explode(sequence(0, {upto})) g AS {alias}"
        return f"{table}, generate_series(0, {upto}) AS g({alias})"

    def ts_format(self, col: str) -> str:
        """Timestamp as 'YYYYmmdd_HHMMSS'."""
        if self.name == "spark":
            return f"date_format({col}, 'yyyyMMdd_HHmmss')"
        return f"strftime({col}, '%Y%m%d_%H%M%S')"

    def struct_list(self, fields, order: str, where: str | None = None) -> str:
        """Ordered list of structs aggregated per group (fields: [(name, expr)])."""
        if self.name == "spark":
            st = "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in fields) + ")"
            src = st if where is None else f"CASE WHEN {where} THEN {st} END"
            return (f"transform(array_sort(collect_list(named_struct('k', {order}, 'v', {src}))), x -> x.v)"
                    if where is None else
                    f"transform(filter(array_sort(collect_list(named_struct('k', {order}, 'v', {src}))), "
                    f"x -> x.v IS NOT NULL), x -> x.v)")
        st = "{" + ", ".join(f"'{n}': {e}" for n, e in fields) + "}"
        filt = "" if where is None else f" FILTER (WHERE {where})"
        return f"coalesce(list({st} ORDER BY {order}){filt}, [])"

    def str_map(self, pairs) -> str:
        keys = ", ".join(k for k, _ in pairs)
        vals = ", ".join(v for _, v in pairs)
        if self.name == "spark":
            return f"map_from_arrays(array({keys}), array({vals}))"
        return f"map([{keys}], [{vals}])"


SPARK = Dialect("spark")
DUCKDB = Dialect("duckdb")
#: Entries of a listing document and cards of a booking page: documents grow in number with the
#: tables, not in length.
LISTING_LINES = 40
MENU_LINES = 12
#: Pages of a linked site: sites grow in number.
SITE_PAGES = 50
PAGE_CARDS = 10


def _products(d: Dialect) -> str:
    return """
SELECT p_partkey AS row_id,
       p_name AS product_name,
       CASE WHEN p_partkey % 7 = 0 THEN 'Price not found'
            WHEN p_partkey % 11 = 0 THEN 'Free'
            WHEN p_partkey % 13 = 0 THEN 'Contact us'
            WHEN p_partkey % 17 = 0 THEN NULL
            WHEN p_partkey % 37 = 0 THEN 'Free trial'
            WHEN p_partkey % 41 = 0 THEN ''
            ELSE '$' || printf('%.2f', p_retailprice) END AS price,
       CASE WHEN p_partkey % 29 = 0 THEN NULL
            WHEN p_partkey % 31 = 0 THEN 'Uncategorized'
            ELSE p_type END AS category,
       'Size ' || CAST(p_size AS STRING) || ', '
         || CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS STRING) || ' hr'
                 ELSE CAST(p_size * 5 AS STRING) || ' minutes' END AS description,
       'https://' || lower(replace(p_brand, '#', '')) || '.example.com/products' AS source_url,
       CASE WHEN p_partkey % 19 = 0 THEN NULL
            WHEN p_partkey % 10 = 0 THEN 'true'
            WHEN p_partkey % 10 = 5 THEN 'True'
            ELSE 'false' END AS is_plan,
       CASE WHEN p_partkey % 5 = 0 THEN 'Storage ' || CAST(p_size AS STRING) || ' GB, , Support,'
            ELSE NULL END AS plan_features,
       CASE WHEN p_partkey % 5 = 0 THEN '14-day trial' ELSE NULL END AS trial_info,
       CASE WHEN p_partkey % 23 = 0 THEN NULL
            WHEN p_partkey % 3 = 0 THEN ''
            ELSE p_brand END AS provider,
       CAST(p_partkey % 100 AS DOUBLE) / 100 AS category_confidence,
       p_partkey % 100 >= 30 AS is_valid_category
FROM part"""


def _listing_text(d: Dialect) -> str:
    line = """CASE p_partkey % 6
         WHEN 0 THEN upper(p_type)
         WHEN 1 THEN p_name || ' ..... ' || printf('%.2f', p_retailprice % 100)
                     || CASE WHEN p_size % 2 = 0 THEN ' each' ELSE '' END
         WHEN 2 THEN p_name || ' ' || CASE p_partkey % 5
                         WHEN 0 THEN '$' || printf('%.2f', p_retailprice % 100) || ' or ' || p_brand || ' deal $'
                                     || printf('%.2f', p_retailprice % 10)
                         WHEN 1 THEN '€' || printf('%.2f', p_retailprice % 100)
                         WHEN 2 THEN '£' || printf('%.2f', p_retailprice % 100)
                         WHEN 3 THEN CAST(CAST(floor(p_retailprice) AS BIGINT) % 100 AS STRING) || ' USD'
                         ELSE 'CHF ' || printf('%.2f', p_retailprice % 100) END
                     || CASE WHEN p_size % 2 = 0 THEN ' each' ELSE '' END
         WHEN 3 THEN p_name || chr(10) || printf('%.2f', p_retailprice % 100) || ' EUR'
         WHEN 4 THEN 'Fresh ' || p_name || ' from ' || p_brand
         ELSE '' END"""
    return f"""
SELECT g AS doc_id, 'https://menus.example.com/menu-' || CAST(g AS STRING) || '.pdf' AS source_url,
       {d.agg('line', 'chr(10)', 'p_partkey')} AS text
FROM (SELECT CAST(floor(p_partkey / {LISTING_LINES}) AS BIGINT) AS g, p_partkey, {line} AS line FROM part) AS t
GROUP BY g"""


def _tagged(d: Dialect) -> str:
    return """
SELECT doc_id AS chunk_id,
       'https://docs.example.com/' || CAST(doc_id AS STRING) AS url,
       CASE WHEN doc_id % 13 = 0 THEN NULL ELSE quality = 1 END AS has_product_info,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE toxic = 1 END AS has_price_info,
       CASE WHEN doc_id % 17 = 0 THEN NULL
            WHEN doc_id % 19 = 0 THEN -5.0
            ELSE CAST(doc_id % 101 AS DOUBLE) END AS confidence
FROM labels"""


def _edits(d: Dialect) -> str:
    return """
SELECT row_id AS edit_id,
       CASE row_id % 50 WHEN 1 THEN 'insert' WHEN 2 THEN 'update' ELSE 'delete' END AS op,
       CASE WHEN row_id % 50 = 1 THEN -row_id ELSE row_id END AS row_id,
       CASE WHEN row_id % 100 = 1 THEN '' ELSE 'Edited ' || product_name END AS new_name,
       upper(coalesce(category, 'misc')) AS new_category,
       CASE WHEN row_id % 3 = 0 THEN '' ELSE '$9.99' END AS new_price,
       CASE WHEN row_id % 4 = 0 THEN NULL ELSE 'manual note' END AS new_description,
       source_url
FROM fx_products WHERE row_id % 50 IN (1, 2, 3)"""


def _doc_pages(d: Dialect) -> str:
    page = "substring(text, i * 500 + 1, 500)"
    return f"""
SELECT doc_id, CAST(i AS INT) AS page_no,
       CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE {page} END AS text_a,
       CASE WHEN i % 3 = 1 THEN NULL WHEN doc_id % 5 = 0 THEN '' ELSE {page} END AS text_b,
       {page} AS text_c
FROM {d.series("(SELECT doc_id, text FROM documents WHERE length(text) > 0) AS dd",
               "CAST(ceil(length(text) / 500.0) AS INT) - 1")}"""


def _cells(d: Dialect) -> str:
    t = """CAST(floor(l_orderkey / 8) AS BIGINT) AS doc_id,
       CAST(floor((l_orderkey % 8) / 4) AS INT) AS page_no,
       CAST(l_orderkey % 4 AS INT) AS table_no"""
    empty = "l_orderkey % 13 = 0"
    return f"""
SELECT {t}, 0 AS row_no, 0 AS col_no, CASE WHEN {empty} THEN '' ELSE 'Quantity' END AS cell
FROM (SELECT DISTINCT l_orderkey FROM lineitem) o
UNION ALL SELECT {t}, 0, 1, CASE WHEN {empty} THEN '' ELSE ' Price ' END FROM (SELECT DISTINCT l_orderkey FROM lineitem) o
UNION ALL SELECT {t}, 0, 2, CASE WHEN {empty} THEN NULL WHEN l_orderkey % 7 = 0 THEN '' ELSE 'Flag' END
FROM (SELECT DISTINCT l_orderkey FROM lineitem) o
UNION ALL SELECT {t}, 0, 3, CASE WHEN {empty} OR l_orderkey % 5 = 0 THEN NULL ELSE 'Status' END
FROM (SELECT DISTINCT l_orderkey FROM lineitem) o
UNION ALL SELECT {t}, l_linenumber, 0, CASE WHEN {empty} THEN '' ELSE printf('%.2f', l_quantity) END FROM lineitem
UNION ALL SELECT {t}, l_linenumber, 1, CASE WHEN {empty} THEN '' ELSE printf('%.2f', l_extendedprice) END
FROM lineitem
UNION ALL SELECT {t}, l_linenumber, 2, CASE WHEN {empty} THEN NULL ELSE ' ' || l_returnflag END FROM lineitem
UNION ALL SELECT {t}, l_linenumber, 3, CASE WHEN {empty} OR l_linenumber % 3 = 0 THEN NULL ELSE l_linestatus END
FROM lineitem"""


def _spans(d: Dialect) -> str:
    t = """CAST(floor(l_orderkey / 8) AS BIGINT) AS doc_id, CAST(l_orderkey % 8 AS INT) AS block_no,
       CAST(l_linenumber AS INT) AS line_no"""
    return f"""
SELECT {t}, 0 AS span_no, l_returnflag AS text FROM lineitem
UNION ALL SELECT {t}, 1, l_linestatus FROM lineitem WHERE l_orderkey % 3 <> 0 OR l_linenumber % 2 = 0
UNION ALL SELECT {t}, 2, printf('%.2f', l_tax) FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber % 3 = 0"""


def _doc_meta(d: Dialect) -> str:
    m = d.str_map([("'title'", "'Doc ' || CAST(doc_id AS STRING)"), ("'author'", "source"),
                   ("'creationDate'", "'D:2024'"), ("'lang'", "lang")])
    return f"""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE {m} END AS metadata FROM documents"""


def _links(d: Dialect) -> str:
    url = "'https://h' || CAST({k} % 3 AS STRING) || '.example.com/p/' || CAST({k} AS STRING)"
    parts = []
    for j in (1, 2, 3):
        dst = f"(3 * p_partkey + {j}) % (SELECT count(*) FROM part)"
        frag = " || CASE WHEN p_partkey % 10 = 0 THEN '#top' ELSE '' END" if j == 3 else ""
        parts.append(f"SELECT {url.format(k='p_partkey')} AS src, {j} AS pos, {url.format(k=dst)}{frag} AS dst FROM part")
    return "\nUNION ALL ".join(parts)


def _site_links(d: Dialect) -> str:
    """Links inside sites of SITE_PAGES pages, to one foreign host per site and back, some with a
    fragment; two links of a page differ by their fragment only."""
    g, k = f"CAST(floor(p_partkey / {SITE_PAGES}) AS BIGINT)", f"p_partkey % {SITE_PAGES}"

    def page(host: str, no: str) -> str:
        return f"'https://{host}' || CAST({g} AS STRING) || '.example.com/p/' || CAST({no} AS STRING)"

    def step(a: int, b: int) -> str:
        return f"({a} * ({k}) + {b}) % {SITE_PAGES}"

    here, away = page("s", k), page("away", k)
    top = f"CASE WHEN ({k}) % 5 = 0 THEN '#top' ELSE '' END"
    rows = [(here, 1, page("s", step(2, 1))), (here, 2, page("s", step(2, 2)) + " || " + top),
            (here, 3, page("s", step(2, 1)) + " || '#sec'"), (here, 4, away), (away, 1, page("s", step(7, 3)))]
    return "\nUNION ALL ".join(f"SELECT {src} AS src, {pos} AS pos, {dst} AS dst FROM part" for src, pos, dst in rows)


def _menu_text(d: Dialect) -> str:
    """Menu documents: one in three names its items by codes too short for the line passes (menus
    with section words), one has full names, one is a price list that is no menu."""
    kind = f"CAST(floor(p_partkey / {MENU_LINES}) AS BIGINT) % 3"
    head = f"CASE {kind} WHEN 2 THEN 'OFFICE TOOLS' ELSE CASE WHEN p_size % 2 = 0 THEN 'HOT SOUP' ELSE 'LUNCH BOX' END END"
    cents = "lpad(CAST(p_size % 100 AS STRING), 2, '0')"
    line = f"""CASE WHEN p_partkey % 4 = 0 THEN {head}
         WHEN {kind} = 0 THEN 'W' || CAST(p_size % 10 AS STRING) || ' $' || CAST(p_size AS STRING) || '.' || {cents}
         WHEN {kind} = 1 THEN p_name || ' $' || CAST(p_size AS STRING) || '.' || {cents} || chr(10) || 'with ' || p_brand
         ELSE 'T' || CAST(p_size % 10 AS STRING) || ' £' || CAST(p_size AS STRING) || '.' || {cents} END"""
    return f"""
SELECT g AS doc_id, 'Card' || chr(10) || {d.agg('line', 'chr(10)', 'p_partkey')} || chr(10) AS text
FROM (SELECT CAST(floor(p_partkey / {MENU_LINES}) AS BIGINT) AS g, p_partkey, {line} AS line FROM part) AS t
GROUP BY g"""


def _short_names(d: Dialect) -> str:
    return """
SELECT p_partkey AS row_id,
       CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ab ' WHEN 3 THEN 'abc' WHEN 4 THEN '   '
            ELSE p_name END AS product_name,
       CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Unknown' ELSE 'Price not found' END AS price,
       CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 100 AS DOUBLE) / 100 END AS category_confidence
FROM part"""


def _pdf_meta(d: Dialect) -> str:
    m = d.str_map([("'/Title'", "'Doc ' || CAST(doc_id AS STRING)"), ("'/Producer'", "source"),
                   ("CASE WHEN doc_id % 3 = 0 THEN '/Author' ELSE '/Subject' END", "lang")])
    return f"""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE {m} END AS metadata,
       CAST(ceil(length(text) / 500.0) AS BIGINT) AS n_pages FROM documents"""


def _hrefs(d: Dialect) -> str:
    forms = ["/a", "a/b", "../c", "?q=1", "//cdn.example.org/x", "#t", "mailto:info@example.com",
             "https://other.example.net/doc.pdf", "files/menu.PDF", "/docs/pdf/guide", "/get?download=pdf",
             "./d/./e", "tel:123", "x/../../y", "", "menu/../price-list.pdf#p2", "HTTP://Up.example.com/Z"]
    rows = []
    for i, f in enumerate(forms):
        ct = {0: "'application/pdf'", 1: "'text/html'"}.get(i % 4, "NULL")
        cd = """'attachment; filename="x.pdf"'""" if i == 3 else "NULL"
        rows.append(f"SELECT page_id, url AS base_url, {i} AS pos, '{f}' AS href, CAST({ct} AS STRING) AS content_type, "
                    f"CAST({cd} AS STRING) AS content_disposition FROM pages")
    return "\nUNION ALL ".join(rows)


def _fetch_log(d: Dialect) -> str:
    return """
SELECT 'https://site' || CAST(user_id % 7 AS STRING) || '.example.com/u/' || CAST(user_id AS STRING) AS url,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS attempt,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'timeout' ELSE 'ok' END AS status,
       CASE WHEN event_type IN ('error', 'signup') THEN NULL
            ELSE repeat('x', CAST(floor(value * 20) AS INT)) END AS text
FROM events"""


def _product_answers(d: Dialect) -> str:
    cat = """CASE p_partkey % 7 WHEN 0 THEN lower(p_type) WHEN 1 THEN 'Uncategorized' WHEN 2 THEN 'home'
                  WHEN 3 THEN 'pet grooming' WHEN 4 THEN 'Garden Tools' WHEN 5 THEN '' ELSE 'Wedding Photo' END"""
    obj = ("'{\"product_name\": \"' || p_name || '\", \"price\": \"' || "
           "CASE WHEN p_partkey % 3 = 0 THEN 'Free trial' ELSE '$' || printf('%.2f', p_retailprice) END || "
           "'\", \"category\": \"' || " + cat + " || '\"' || "
           "CASE WHEN p_partkey % 4 = 0 THEN ', \"provider\": \"' || p_brand || '\"' ELSE '' END || '}'")
    second = "'{\"product_name\": \"' || upper(p_name) || '\", \"category\": \"services\"}'"
    resp = f"""CASE p_partkey % 5
         WHEN 0 THEN '[' || {obj} || ', ' || {second} || ']'
         WHEN 1 THEN {obj}
         WHEN 2 THEN '42'
         WHEN 3 THEN 'Here you go:' || chr(10) || '```json' || chr(10) || '[' || {obj} || ']' || chr(10) || '```'
         ELSE '{{"product_name": "' || p_name || '", ' END"""
    text = """'Browse our ' || lower(p_type) || CASE WHEN p_partkey % 2 = 0 THEN ' category' ELSE ' range' END
           || ' of ' || p_name || ' by ' || p_brand || '. <h2>Garden Supplies</h2> <strong>Dog walking</strong> '
           || 'our ' || CASE WHEN p_partkey % 3 = 0 THEN 'repair' ELSE 'wedding' END || ' services and '
           || lower(p_brand) || ' packages, types of tools. Photo sessions weekly.'
           || CASE WHEN p_partkey % 4 = 0 THEN ' Ask about the special bundle deal for ' || p_name || '. Plans from $19;'
                   || ' free consultation on request; choose from options available; 2 hours tutoring $45.'
                   ELSE '' END"""
    return f"""
SELECT p_partkey AS chunk_id, 'https://' || lower(replace(p_brand, '#', '')) || '.example.com/shop' AS url,
       {text} AS text, {resp} AS response
FROM part"""


def _tag_answers(d: Dialect) -> str:
    return """
SELECT d.doc_id AS chunk_id, 'https://docs.example.com/' || CAST(d.doc_id AS STRING) AS url,
       CASE d.doc_id % 5
         WHEN 0 THEN '{"has_product_info": ' || CASE WHEN l.quality = 1 THEN 'true' ELSE 'false' END
                     || ', "has_price_info": ' || CASE WHEN l.toxic = 1 THEN 'true' ELSE 'false' END
                     || ', "confidence": ' || CAST(d.doc_id % 101 AS STRING) || ', "reasoning": "lang ' || d.lang || '"}'
         WHEN 1 THEN '```json' || chr(10) || '{"has_product_info": true, "confidence": 75}' || chr(10) || '```'
         WHEN 2 THEN '```' || chr(10) || '{"has_price_info": true, "reasoning": "fenced"}' || chr(10) || '```'
         WHEN 3 THEN '{"has_product_info": true, "confidence": '
         ELSE '{}' END AS response
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def _fuel_text(d: Dialect) -> str:
    cents = "CAST(floor(200 + (s_acctbal % 100) + {k} * 100) AS BIGINT)"
    p = ("'$' || CAST(CAST(floor(" + cents + " / 100) AS BIGINT) AS STRING) || '.' || "
         "lpad(CAST(" + cents + " % 100 AS STRING), 2, '0')")
    nl = "chr(10)"
    url = """CASE s_suppkey % 3 WHEN 0 THEN 'https://www.shell-' || CAST(s_suppkey AS STRING) || '.example.com/station'
                  WHEN 1 THEN 'https://stations.example.com/loves.com/locations/' || CAST(s_suppkey AS STRING)
                  ELSE 'https://shop.example.com/s/' || CAST(s_suppkey AS STRING) END"""
    text = f"""CASE s_suppkey % 4
      WHEN 0 THEN 'Station ' || s_name || {nl} || {p.format(k='0.1')} || {nl} || 'UNLEADED' || {nl}
                  || {p.format(k='0.5')} || {nl} || 'Diesel' || {nl} || {p.format(k='0.7')} || {nl} || 'PREMIUM' || {nl}
                  || 'DEF fluid available' || {nl} || {p.format(k='0.8')}
      WHEN 1 THEN 'REGULAR UNLEADED' || {nl} || {p.format(k='0.2')} || {nl} || 'midgrade' || {nl}
                  || {p.format(k='0.4')} || {nl} || 'AUTO DIESEL' || {nl} || {p.format(k='0.6')} || ' per gallon'
      WHEN 2 THEN 'Diesel ' || {p.format(k='0.3')} || {nl} || 'x' || {nl} || 'x' || {nl} || 'x' || {nl} || 'x'
                  || {nl} || 'x' || {nl} || 'PROPANE' || {nl} || 'x' || {nl} || 'x' || {nl} || 'x' || {nl} || 'x'
                  || {nl} || 'x' || {nl} || 'x' || {nl} || {p.format(k='0.9')} || ' for premium gas'
      ELSE 'PROPANE' || {nl} || 'Call for prices' || {nl} || 'Ethanol blend E85 gas price soon' END"""
    return f"""
SELECT s_suppkey AS chunk_id, {url} AS url, {text} AS text FROM supplier"""


def _booking_html(d: Dialect) -> str:
    name = """CASE c_custkey % 5 WHEN 0 THEN 'Anna Berg' WHEN 1 THEN 'Carl Dunn' WHEN 2 THEN 'Eva Field'
                   WHEN 3 THEN 'Gus Hale' ELSE 'Ida Jones' END"""
    service = "upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Review'"
    minutes = "CAST(15 * (1 + c_custkey % 4) AS STRING) || ' minutes'"
    price = f"""CASE c_custkey % 4
        WHEN 0 THEN '<span class="price">$' || CAST(CAST(floor(c_acctbal) AS BIGINT) % 500 AS STRING) || '</span>'
        WHEN 1 THEN '<p>Free first session</p>'
        WHEN 2 THEN ''
        ELSE '<p>from $' || CAST(CAST(floor(c_acctbal) AS BIGINT) % 300 AS STRING) || '</p>' END"""
    card = f"""CASE WHEN c_custkey % 7 = 0
        THEN {name} || chr(10) || {service} || ' ' || {minutes} || ' · $' || CAST(CAST(floor(c_acctbal) AS BIGINT) % 90 AS STRING)
        ELSE '<div class="service-card"><h3 class="provider">' || {name} || '</h3><h4 class="service-name">'
             || {service} || '</h4><span class="duration">' || {minutes} || '</span>' || {price} || '</div>' END"""
    url = """CASE g % 3 WHEN 0 THEN 'https://law-office' || CAST(g AS STRING) || '.example.com/book'
                 WHEN 1 THEN 'https://clinic' || CAST(g AS STRING) || '.example.com/appointment'
                 ELSE 'https://shop' || CAST(g AS STRING) || '.example.com/catalog' END"""
    return f"""
SELECT g AS page_id, {url} AS url,
       '<html><body>' || {d.agg('card', 'chr(10)', 'c_custkey')} || chr(10) || '</body></html>' AS html
FROM (SELECT CAST(floor(c_custkey / {PAGE_CARDS}) AS BIGINT) AS g, c_custkey, {card} AS card FROM customer) t GROUP BY g"""


def _ext_items(d: Dialect) -> str:
    return """
SELECT p_partkey AS item_id, 'https://catalog.example.com/' || lower(replace(p_brand, '#', '')) AS url,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_name END AS name,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE '$' || printf('%.2f', p_retailprice) END AS price,
       CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_type END AS category,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'Size ' || CAST(p_size AS STRING) END AS description,
       CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS brand,
       CASE WHEN p_partkey % 3 = 0 THEN 'in stock' END AS availability,
       CAST(NULL AS STRING) AS image_url,
       CASE WHEN p_partkey % 7 = 0 THEN 'SKU-' || CAST(p_partkey AS STRING) END AS sku
FROM part"""


def _fuel_html(d: Dialect) -> str:
    cents = "CAST(floor(200 + (s_acctbal % 100) + {k} * 100) AS BIGINT)"
    p = ("'$' || CAST(CAST(floor(" + cents + " / 100) AS BIGINT) AS STRING) || '.' || "
         "lpad(CAST(" + cents + " % 100 AS STRING), 2, '0')")
    body = f"""CASE s_suppkey % 4
      WHEN 0 THEN '<div class="grid"><div class="card"><span>Unleaded</span><span>' || {p.format(k='0.1')}
                  || '</span></div><div class="card"><span>Diesel</span><span>' || {p.format(k='0.5')}
                  || '</span></div><div class="card"><span>Premium &amp; more</span><span>'
                  || {p.format(k='0.7')} || '</span></div></div>'
      WHEN 1 THEN '<p>Regular <b>' || {p.format(k='0.2')} || '</b> today</p><p>DEF</p><p>Call us</p>'
      WHEN 2 THEN '<ul><li>PROPANE</li><li>Plus</li></ul><div>' || {p.format(k='0.3')} || '</div><li>Propane</li>'
      ELSE '<div>No prices for E85 today</div>' END"""
    return f"""
SELECT s_suppkey AS chunk_id, 'https://fuel' || CAST(s_suppkey AS STRING) || '.example.com/prices' AS url,
       '<html><body><h1>' || s_name || '</h1>' || {body} || '</body></html>' AS text FROM supplier"""


ARCHIVE_ITEM = [("product_name", "'Order ' || CAST(o_orderkey AS STRING)"),
                ("price", "'$' || printf('%.2f', o_totalprice)"),
                ("category", "o_orderpriority")]


_PAGE = ("url", "'https://shop.example.com/o/' || CAST(o_orderkey AS STRING)")
#: Lists of a saved scrape: name, fields, condition.
SCRAPE_LISTS = [
    ("products", ARCHIVE_ITEM, None),
    ("deduplicated_data", ARCHIVE_ITEM, "o_orderkey % 3 <> 0"),
    ("scraped_content", [_PAGE, ("text", "'Order ' || CAST(o_orderkey AS STRING) || ' ' || o_orderpriority")], None),
    ("chunks", [_PAGE, ("text", "o_orderpriority")], "o_orderkey % 2 = 0"),
    ("tagged_chunks", [_PAGE, ("has_price_info", "o_totalprice > 100000")], "o_orderkey % 2 = 0"),
]


def _scrape_lists(d: Dialect, products: str | None = None) -> str:
    """The five lists as aggregates; ``products``: condition on the product list."""
    return ",\n       ".join(f"{d.struct_list(fields, 'o_orderkey', products if name == 'products' else where)} AS {name}"
                            for name, fields, where in SCRAPE_LISTS)


def _archive(d: Dialect) -> str:
    return f"""
SELECT md5(url) || '_' || ts AS scrape_id, a.* FROM (
  SELECT 'https://shop.example.com/c/' || CAST(o_custkey AS STRING) AS url,
         {d.ts_format('max(o_orderdate)')} AS ts,
         {_scrape_lists(d)}
  FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00' GROUP BY o_custkey) a"""


def _new_scrapes(d: Dialect) -> str:
    # up to two scrapes of a URL in one batch
    return f"""
SELECT 'https://shop.example.com/c/' || CAST(o_custkey AS STRING) AS url, ts,
       {_scrape_lists(d, "o_orderstatus = 'F' OR o_orderkey % 2 = 0")}
FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN '20990201_000000' ELSE '20990101_000000' END AS ts
      FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00') o GROUP BY o_custkey, ts"""


# name -> (dependencies, sql builder)
FIXTURES: dict[str, tuple[tuple[str, ...], callable]] = {
    "fx_products": ((), _products),
    "fx_listing_text": ((), _listing_text),
    "fx_tagged": ((), _tagged),
    "fx_doc_pages": ((), _doc_pages),
    "fx_cells": ((), _cells),
    "fx_spans": ((), _spans),
    "fx_doc_meta": ((), _doc_meta),
    "fx_links": ((), _links),
    "fx_site_links": ((), _site_links),
    "fx_menu_text": ((), _menu_text),
    "fx_short_names": ((), _short_names),
    "fx_pdf_meta": ((), _pdf_meta),
    "fx_fuel_text": ((), _fuel_text),
    "fx_archive": ((), _archive),
    "fx_new_scrapes": ((), _new_scrapes),
    "fx_fuel_html": ((), _fuel_html),
    "fx_booking_html": ((), _booking_html),
    "fx_ext_items": ((), _ext_items),
    "fx_product_answers": ((), _product_answers),
    "fx_tag_answers": ((), _tag_answers),
    "fx_hrefs": ((), _hrefs),
    "fx_fetch_log": ((), _fetch_log),
    "fx_edits": (("fx_products",), _edits),
}


def _order(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        for dep in FIXTURES[n][0]:
            visit(dep)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    return seen


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Register the stored tables and the fixture's dependencies, return the fixture."""
    register_tables(spark, sf_dir)
    df = None
    for n in _order([name]):
        df = spark.sql(FIXTURES[n][1](SPARK))
        df.createOrReplaceTempView(n)
    return df


def with_fixtures(names, body: str) -> str:
    """Prefix an oracle query with the fixtures it reads, as CTEs (DuckDB dialect)."""
    ctes = [f"{n} AS ({FIXTURES[n][1](DUCKDB)})" for n in _order(names)]
    body = body.strip()
    if not ctes:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
