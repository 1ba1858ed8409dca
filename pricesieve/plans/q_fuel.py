"""Registered queries for fuel pages and presentation style."""
from __future__ import annotations

from pyspark.sql import functions as F

from pricesieve import constants as K
from pricesieve.operators import fuel
from pricesieve.plans import q_answers, q_booking  # noqa: F401  (their oracles are parts of the cascade's)
from pricesieve.plans import sqlfrag as S
from pricesieve.plans.fixtures import fixture
from pricesieve.plans.registry import SQL, register

FX = ["fx_fuel_text"]
_SPLIT = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def _lines(src: str) -> str:
    return f"""(SELECT chunk_id, url, i - 1 AS line_no, parts[i] AS line
  FROM (SELECT chunk_id, url, string_split_regex(text, '{_SPLIT}') AS parts FROM {src}) s,
       generate_series(1, len(parts)) AS g(i))"""


_DESC = f"'{K.FUEL_DESCRIPTION_PREFIX}' || url"


def _fx(spark, sf):
    return fixture(spark, sf, "fx_fuel_text")


def _any(expr_fmt, words):
    return "(" + " OR ".join(expr_fmt.format(S.q(w)) for w in words) + ")"


@register("fuel_chunks", FX, f"""
SELECT chunk_id, url, text,
  {_any("contains(lower(coalesce(url, '')), {})", K.FUEL_URL_WORDS)}
  OR {_any("contains(lower(coalesce(text, '')), {})", K.FUEL_TEXT_WORDS)} AS is_fuel
FROM fx_fuel_text""")
def q_fuel_chunks(spark, sf):
    return fuel.fuel_chunks(_fx(spark, sf))


_TYPES = "[" + ", ".join(S.q(t) for t in K.FUEL_TYPES_SHORT) + "]"


@register("fuel_price_above", FX, f"""
WITH c AS (
  SELECT * FROM fx_fuel_text
  WHERE len(list_filter({_TYPES}, lambda t: contains(lower(text), lower(t)))) > 0
    AND len(regexp_extract_all(text, '\\$(\\d+\\.\\d+)', 0))
        >= len(list_filter({_TYPES}, lambda t: contains(lower(text), lower(t))))),
l AS {_lines('c')},
f AS (SELECT chunk_id, url, ftype, max(line_no) AS line_no FROM (
        SELECT chunk_id, url, line_no, unnest(list_filter({_TYPES}, lambda t: contains(lower(line), lower(t)))) AS ftype
        FROM l) x GROUP BY ALL),
p AS (SELECT chunk_id, line_no, regexp_extract(line, '\\$(\\d+\\.\\d+)', 0) AS price FROM l
      WHERE regexp_matches(line, '\\$(\\d+\\.\\d+)'))
SELECT f.chunk_id, ftype AS product_name, arg_max(p.price, p.line_no) AS price, 'Fuel' AS category,
       {_DESC.replace('url', 'f.url')} AS description, f.url AS source_url
FROM f JOIN p ON p.chunk_id = f.chunk_id AND p.line_no < f.line_no
GROUP BY f.chunk_id, f.url, ftype, f.line_no""")
def q_fuel_price_above(spark, sf):
    return fuel.fuel_price_above(_fx(spark, sf))


def _first_type_sql(col):
    out = "NULL"
    for t in reversed(K.FUEL_TYPES):
        out = f"CASE WHEN regexp_matches({col}, {S.q('(?i)\\b' + t + '\\b')}) THEN {S.q(t)} ELSE {out} END"
    return out


@register("fuel_price_near", FX, f"""
WITH l AS {_lines('fx_fuel_text')},
l2 AS (SELECT chunk_id, url, line_no, {_first_type_sql('line')} AS ftype,
              CASE WHEN regexp_matches(line, '\\$(\\d+\\.\\d+)') THEN '$' || regexp_extract(line, '\\$(\\d+\\.\\d+)', 1) END
                AS price FROM l),
f AS (SELECT * FROM l2 WHERE ftype IS NOT NULL),
p AS (SELECT chunk_id, line_no, price FROM l2 WHERE price IS NOT NULL),
b AS (SELECT f.chunk_id, f.url, f.line_no, f.ftype,
             arg_min(p.price, [abs(p.line_no - f.line_no), p.line_no]) AS price,
             min(abs(p.line_no - f.line_no)) AS dist
      FROM f JOIN p ON p.chunk_id = f.chunk_id GROUP BY ALL)
SELECT chunk_id, ftype AS product_name, price, 'Fuel' AS category, {_DESC} AS description, url AS source_url
FROM b WHERE dist <= 5""")
def q_fuel_price_near(spark, sf):
    return fuel.fuel_price_near(_fx(spark, sf))


def _regex_items_sql():
    parts = []
    for i, p in enumerate(K.FUEL_REGEXES):
        rx = S.q("(?i)" + p)
        parts.append(f"list_transform(list_zip(regexp_extract_all(text, {rx}, 1), regexp_extract_all(text, {rx}, 2)), "
                     f"lambda x: {{'pattern_no': {i}, 'g1': x[1], 'g2': x[2]}})")
    allp = parts[0]
    for p in parts[1:]:
        allp = f"list_concat({allp}, {p})"
    return allp


@register("fuel_regex", FX, f"""
SELECT chunk_id, i - 1 AS pos, m[i].pattern_no AS pattern_no,
       upper({S.strip("CASE WHEN contains(m[i].g1, '$') THEN m[i].g2 ELSE m[i].g1 END")}) AS product_name,
       {S.strip("CASE WHEN contains(m[i].g1, '$') THEN m[i].g1 ELSE m[i].g2 END")} AS price,
       'Fuel' AS category, {_DESC} AS description, url AS source_url
FROM (SELECT chunk_id, url, {_regex_items_sql()} AS m FROM fx_fuel_text) s, generate_series(1, len(m)) AS g(i)""")
def q_fuel_regex(spark, sf):
    return fuel.fuel_regex(_fx(spark, sf))


def _cat_items_sql():
    parts = [f"list_transform(regexp_extract_all(text, {S.q('(?i)' + p)}, 0), lambda m: {{'pattern_no': {i}, 'm': m}})"
             for i, p in enumerate(K.FUEL_CATEGORY_PATTERNS)]
    allp = parts[0]
    for p in parts[1:]:
        allp = f"list_concat({allp}, {p})"
    return allp


_FALLBACK = "'Fuel'"
for _w, _n in reversed(K.FUEL_FALLBACK_NAMES):
    _FALLBACK = f"CASE WHEN contains(lower(text), {S.q(_w)}) THEN {S.q(_n)} ELSE {_FALLBACK} END"


@register("fuel_patterns", FX, f"""
SELECT chunk_id, pos, pattern_no,
       CASE WHEN rest <> '' THEN rest ELSE {_FALLBACK} END AS product_name, price, 'Fuel' AS category,
       {_DESC} AS description, url AS source_url FROM (
  SELECT chunk_id, url, text, i - 1 AS pos, x[i].pattern_no AS pattern_no,
         regexp_extract(x[i].m, '\\$\\d+\\.?\\d*', 0) AS price,
         {S.strip("regexp_replace(x[i].m, '\\$\\d+\\.?\\d*', '', 'g')")} AS rest
  FROM (SELECT chunk_id, url, text, {_cat_items_sql()} AS x FROM fx_fuel_text) s, generate_series(1, len(x)) AS g(i)) y
WHERE price <> ''""")
def q_fuel_patterns(spark, sf):
    return fuel.fuel_patterns(_fx(spark, sf))


def _style_sql(t):
    t = f"lower({t})"
    return f"""CASE WHEN {_any(f"contains({t}, {{}})", ['<table', '</tr>', '</td>'])} THEN 'table'
      WHEN {_any(f"contains({t}, {{}})", ['<li>', '•', '*'])} THEN 'bullet_list'
      WHEN contains({t}, '<div class=') AND (contains({t}, 'product') OR contains({t}, 'grid')) THEN 'grid'
      WHEN contains({t}, 'menu') AND (contains({t}, '$') OR contains({t}, 'price')) THEN 'menu'
      WHEN {_any(f"contains({t}, {{}})", ['package', 'plan', 'tier', 'subscription', 'pricing'])} THEN 'packages'
      WHEN {_any(f"contains({t}, {{}})", ['fuel', 'gas', 'diesel'])} THEN 'fuel_prices'
      ELSE 'unknown' END"""


def _of(source: str, key: str):
    """Chunk id of an input made of several tables: source and key."""
    return F.concat(F.lit(source + ":"), F.col(key).cast("string")).alias("chunk_id")


@register("style", FX + ["fx_listing_text"], f"""
SELECT 'fuel:' || chunk_id AS chunk_id, {_style_sql('text')} AS style FROM fx_fuel_text
UNION ALL SELECT 'listing:' || doc_id, {_style_sql('text')} FROM fx_listing_text
UNION ALL SELECT 'page:' || page_id, {_style_sql('html')} FROM pages""")
def q_style(spark, sf):
    from pricesieve.sources.tables import read_table
    a = _fx(spark, sf).select(_of("fuel", "chunk_id"), "text")
    b = fixture(spark, sf, "fx_listing_text").select(_of("listing", "doc_id"), "text")
    c = read_table(spark, sf, "pages").select(_of("page", "page_id"), F.col("html").alias("text"))
    u = a.unionByName(b).unionByName(c)
    return u.select("chunk_id", fuel.style(F.col("text")).alias("style"))


_CONT = "|".join(fuel.CONTAINER_TAGS)


def _nodes_sql(src: str) -> str:
    from pricesieve.plans.sqlfrag import drop_invisible
    return f"""(SELECT chunk_id, url, pos, container, {S.unescape('piece')} AS node FROM (
  SELECT chunk_id, url, i - 1 AS pos, pieces[i] AS piece,
         sum(CASE WHEN starts_with(pieces[i], '<') AND regexp_matches(pieces[i], '(?i)^</?(?:{_CONT})\\b') THEN 1 ELSE 0 END)
           OVER (PARTITION BY chunk_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS container
  FROM (SELECT chunk_id, url, string_split(regexp_replace({drop_invisible('text')}, '(<[^>]*>)', chr(3) || '\\1' || chr(3), 'g'),
                                     chr(3)) AS pieces FROM {src}) s,
       generate_series(1, len(pieces)) AS g(i)) x
 WHERE NOT starts_with(piece, '<') AND piece <> '')"""


def _type_no_sql(col):
    import re as _re
    out = "NULL"
    for i, t in reversed(list(enumerate(K.FUEL_TYPES))):
        out = f"CASE WHEN regexp_matches({col}, {S.q('(?i)' + _re.escape(t).replace(chr(92) + ' ', ' ').replace(chr(92) + '#', '#'))}) THEN {i} ELSE {out} END"
    return out


@register("fuel_price_nodes", ["fx_fuel_html"], f"""
WITH n AS (SELECT *, {_type_no_sql('node')} AS type_no, regexp_matches(node, '\\$\\d+\\.\\d+') AS is_price
           FROM {_nodes_sql('fx_fuel_html')} x),
c AS (SELECT chunk_id, container,
             arg_min(CASE WHEN is_price THEN node END, CASE WHEN is_price THEN pos END) AS cp,
             arg_max(CASE WHEN is_price THEN node END, CASE WHEN is_price THEN pos END) AS lp
      FROM n GROUP BY ALL),
c2 AS (SELECT *, last_value(lp IGNORE NULLS) OVER (PARTITION BY chunk_id ORDER BY container
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_p,
                 first_value(cp IGNORE NULLS) OVER (PARTITION BY chunk_id ORDER BY container
                   ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_p FROM c),
f AS (SELECT chunk_id, node, arg_min(container, [type_no, pos]) AS container, arg_min(url, [type_no, pos]) AS url
      FROM n WHERE type_no IS NOT NULL GROUP BY ALL)
SELECT f.chunk_id, upper({S.strip('f.node')}) AS product_name, {S.strip('coalesce(cp, prev_p, next_p)')} AS price,
       'Fuel' AS category, 'Fuel price at ' || f.url AS description, f.url AS source_url
FROM f JOIN c2 ON f.chunk_id = c2.chunk_id AND f.container = c2.container
WHERE coalesce(cp, prev_p, next_p) IS NOT NULL""")
def q_fuel_price_nodes(spark, sf):
    return fuel.fuel_price_nodes(fixture(spark, sf, "fx_fuel_html"))


def _stage(priority: int, name: str, key: str, source: str, where: str, cols: str = "*", provider: str = "NULL") -> str:
    """Rows of the oracle ``key`` over the chunks of ``where``, put in place of ``source``."""
    chunk = "page_id" if source == "fx_booking_html" else "chunk_id"
    return f"""SELECT {chunk} AS chunk_id, {priority} AS priority, product_name, price, category, description, source_url,
       CAST({provider} AS VARCHAR) AS provider, '{name}' AS extracted_by
FROM (WITH {source} AS (SELECT {cols} FROM {where}) SELECT * FROM ({SQL[key]}) r) s"""


def _cascade_sql() -> str:
    is_fuel = (_any("contains(lower(coalesce(url, '')), {})", K.FUEL_URL_WORDS) + " OR "
               + _any("contains(lower(coalesce(text, '')), {})", K.FUEL_TEXT_WORDS))
    page = "chunk_id AS page_id, url, text AS html"
    book = f"cc WHERE {_any('contains(url, {})', K.BOOKING_URL_WORDS)}"
    parts = [
        _stage(1, "fuel_above", "fuel_price_above", "fx_fuel_text", f"fc WHERE contains(url, {S.q(K.LOVES_LOCATIONS)})"),
        _stage(2, "fuel_nodes", "fuel_price_nodes", "fx_fuel_html", "fc"),
        _stage(3, "fuel_near", "fuel_price_near", "fx_fuel_text", "fc"),
        _stage(4, "fuel_regex", "fuel_regex", "fx_fuel_text", "fc"),
        _stage(5, "booking_cards", "booking_cards", "fx_booking_html", book, page, "provider"),
        _stage(6, "booking_regex", "booking_regex", "fx_booking_html", book, page, "provider"),
        _stage(7, "fuel_patterns", "fuel_patterns", "fx_fuel_text", f"cc WHERE {_style_sql('text')} = 'fuel_prices'"),
        _stage(8, "model_answer", "category_relabel", "fx_product_answers", "pa", provider="provider"),
    ]
    return f"""
WITH pa AS (SELECT 'answer:' || chunk_id AS chunk_id, url, text, response FROM fx_product_answers),
cc AS (SELECT 'fuel:' || chunk_id AS chunk_id, url, text FROM fx_fuel_text
  UNION ALL SELECT 'html:' || chunk_id, url, text FROM fx_fuel_html
  UNION ALL SELECT 'booking:' || page_id, url, html FROM fx_booking_html
  UNION ALL SELECT chunk_id, url, text FROM pa),
fc AS (SELECT * FROM cc WHERE {is_fuel})
SELECT * FROM ({' UNION ALL '.join(parts)}) u
QUALIFY priority = min(priority) OVER (PARTITION BY chunk_id)"""


@register("cascade", ["fx_fuel_text", "fx_fuel_html", "fx_booking_html", "fx_product_answers"], _cascade_sql())
def q_cascade(spark, sf):
    from pricesieve.operators.cascade import cascade
    a = fixture(spark, sf, "fx_fuel_text").select(_of("fuel", "chunk_id"), "url", "text")
    b = fixture(spark, sf, "fx_fuel_html").select(_of("html", "chunk_id"), "url", "text")
    c = fixture(spark, sf, "fx_booking_html").select(_of("booking", "page_id"), "url", F.col("html").alias("text"))
    pa = fixture(spark, sf, "fx_product_answers")
    d = pa.select(_of("answer", "chunk_id"), "url", "text")
    ans = pa.select(_of("answer", "chunk_id"), "response")
    return cascade(a.unionByName(b).unionByName(c).unionByName(d), ans)
