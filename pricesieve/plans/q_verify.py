"""Registered queries for the completeness check (group V)."""
from __future__ import annotations

from pricesieve.operators import verify
from pricesieve.plans.fixtures import fixture
from pricesieve.plans.q_answers import unfence_sql
from pricesieve.plans.registry import SQL, register

P =["fx_products"]
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
_FIND = f"""(
SELECT 'missing_product_indicators' AS kind, row_id FROM fx_products
WHERE product_name IS NULL OR product_name = ''
   OR length(regexp_replace(product_name, '^{_WS}+|{_WS}+$', '', 'g')) < 3
UNION ALL SELECT 'missing_price_indicators', row_id FROM fx_products WHERE price IS NULL OR price = '' OR price = 'Unknown'
UNION ALL SELECT 'missing_category_indicators', row_id FROM fx_products WHERE category_confidence < 0.4)"""


@register("v_findings", P, f"SELECT * FROM {_FIND} f")
def q_v_findings(spark, sf):
    return verify.findings(fixture(spark, sf, "fx_products"))


@register("v_findings_short", ["fx_short_names"], f"SELECT * FROM {_FIND.replace('fx_products', 'fx_short_names')} f")
def q_v_findings_short(spark, sf):
    """V1-V3 on rows with missing, blank and short names."""
    return verify.findings(fixture(spark, sf, "fx_short_names"))


@register("v_suggestions", P, f"""
SELECT kind, count(*) AS n,
  CASE kind WHEN 'missing_product_indicators' THEN 'Found ' || count(*) || ' products with missing or very short names.'
            WHEN 'missing_price_indicators' THEN 'Found ' || count(*) || ' products with missing prices.'
            ELSE 'Found ' || count(*) || ' products with low category confidence.' END AS suggestion
FROM {_FIND} f GROUP BY kind""")
def q_v_suggestions(spark, sf):
    return verify.suggestions(verify.findings(fixture(spark, sf, "fx_products")))


@register("v_score", P, f"""
SELECT n_findings, score AS completeness_score, score < 0.9 AS warning FROM (
  SELECT count(*) AS n_findings,
         CASE WHEN count(*) = 0 THEN 1.0 ELSE greatest(0.0, 1.0 - count(*) * 0.05) END AS score FROM {_FIND} f) x""")
def q_v_score(spark, sf):
    return verify.completeness(verify.findings(fixture(spark, sf, "fx_products")))


from pricesieve import constants as _K  # noqa: E402
from pricesieve.plans import sqlfrag as _S  # noqa: E402


def _indicator_sql(table: str = "fx_product_answers") -> str:
    parts = []
    for i, (p, kind) in enumerate(_K.PRODUCT_INDICATORS):
        pieces = f"string_split(regexp_replace(text, {_S.q('(?i)' + p)}, chr(4) || '\\0' || chr(4), 'g'), chr(4))"
        parts.append(f"""SELECT chunk_id, url, {i} AS indicator_no, {_S.q(kind)} AS type, pieces[2 * k] AS match,
       length(array_to_string(pieces[1:2 * k - 1], '')) AS position, text
FROM (SELECT *, {pieces} AS pieces FROM {table}) x,
     generate_series(1, CAST(floor((len(pieces) - 1) / 2) AS BIGINT)) AS g(k)""")
    return "(" + "\nUNION ALL ".join(parts) + ")"


_NAMES = f"""names AS (SELECT DISTINCT source_url AS url, lower(product_name) AS name FROM (
  SELECT c.url AS source_url, coalesce(json_extract_string(it, '$.product_name'), 'Unknown Product') AS product_name
  FROM (SELECT url, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]')
                          WHEN json_type(j) = 'OBJECT' THEN [CAST(j AS JSON)] END AS items
        FROM (SELECT url, {unfence_sql('response')} AS j FROM fx_product_answers) a
        WHERE coalesce(json_valid(j), false)) c, unnest(c.items) AS u(it)) p)"""


@register("v_indicators", ["fx_product_answers"], f"""
WITH m AS (
  SELECT chunk_id, url, indicator_no, type, match,
         substring(text, greatest(position - 100, 0) + 1,
                   least(length(text), position + length(match) + 100) - greatest(position - 100, 0)) AS context,
         position
  FROM {_indicator_sql()} i),
{_NAMES}
SELECT * FROM m WHERE NOT EXISTS (
  SELECT 1 FROM names n WHERE n.url = m.url AND n.name <> '' AND instr(lower(m.context), n.name) > 0)""")
def q_v_indicators(spark, sf):
    from pricesieve.operators import answers
    pa = fixture(spark, sf, "fx_product_answers")
    products = answers.answer_items(pa)
    return verify.indicators(pa.select("chunk_id", "url", "text"), products)


#: The stored answers' texts with every chunk's words dealt to four chunks, so that phrases cross
#: the ends of chunks.
_CUT = """(SELECT 4 * chunk_id + part AS chunk_id, url, CASE part
    WHEN 0 THEN array_to_string(w[1:len(w) // 4], ' ')
    WHEN 1 THEN array_to_string(w[len(w) // 4 + 1:len(w) // 2], ' ')
    WHEN 2 THEN array_to_string(w[len(w) // 2 + 1:3 * len(w) // 4], ' ')
    ELSE array_to_string(w[3 * len(w) // 4 + 1:], ' ') END AS text
  FROM (SELECT chunk_id, url, string_split(text, ' ') AS w FROM fx_product_answers) s, range(4) AS p(part))"""


def cut_chunks(pa):
    """The same rows with Spark."""
    from pyspark.sql import functions as F
    w = pa.select("chunk_id", "url", F.split("text", " ").alias("w"))
    n = F.size("w")
    ends = [F.floor(n * F.lit(k) / 4).cast("int") for k in range(5)]
    part = F.array(*(F.struct(F.lit(k).alias("k"), F.array_join(F.slice("w", ends[k] + 1, ends[k + 1] - ends[k]), " ").alias("text"))
                     for k in range(4)))
    return w.select("chunk_id", "url", F.explode(part).alias("p")).select(
        (4 * F.col("chunk_id") + F.col("p.k")).alias("chunk_id"), "url", "p.text")


@register("v_indicators_page", ["fx_product_answers"], f"""
WITH page AS (SELECT 0 AS chunk_id, url, string_agg(text, ' ' ORDER BY chunk_id) AS text FROM {_CUT} c GROUP BY url),
m AS (
  SELECT url, indicator_no, type, match,
         substring(text, greatest(position - 100, 0) + 1,
                   least(length(text), position + length(match) + 100) - greatest(position - 100, 0)) AS context,
         position
  FROM {_indicator_sql('page')} i),
{_NAMES}
SELECT * FROM m WHERE NOT EXISTS (
  SELECT 1 FROM names n WHERE n.url = m.url AND n.name <> '' AND instr(lower(m.context), n.name) > 0)""")
def q_v_indicators_page(spark, sf):
    from pricesieve.operators import answers
    pa = fixture(spark, sf, "fx_product_answers")
    return verify.page_indicators(cut_chunks(pa), answers.answer_items(pa))


_TEXT_FIND = f"""(
SELECT 'missing_product_indicators' AS kind FROM ({SQL['v_indicators']}) m
UNION ALL SELECT 'missing_price_indicators' FROM ({SQL['category_relabel']}) r WHERE price IS NULL OR price = '' OR price = 'Unknown'
UNION ALL SELECT 'missing_category_indicators' FROM ({SQL['category_relabel']}) r WHERE category_confidence < 0.4)"""


def _text_findings(spark, sf):
    from pyspark.sql import functions as F

    from pricesieve.operators import answers
    pa = fixture(spark, sf, "fx_product_answers")
    items = answers.answer_items(pa)
    missed = verify.indicators(pa.select("chunk_id", "url", "text"), items)
    return verify.text_findings(answers.category_relabel(items).withColumn("row_id", F.struct("chunk_id", "item_no")), missed)


@register("v_text_suggestions", ["fx_product_answers"], f"""
SELECT kind, count(*) AS n,
  CASE kind WHEN 'missing_product_indicators'
            THEN 'Found ' || count(*) || ' potential product indicators that may not be captured in the data.'
            WHEN 'missing_price_indicators' THEN 'Found ' || count(*) || ' products with missing prices.'
            ELSE 'Found ' || count(*) || ' products with low category confidence.' END AS suggestion
FROM {_TEXT_FIND} f GROUP BY kind""")
def q_v_text_suggestions(spark, sf):
    return verify.suggestions(_text_findings(spark, sf), _K.TEXT_FINDING_MESSAGES)


@register("v_text_score", ["fx_product_answers"], f"""
SELECT n_findings, score AS completeness_score, score < 0.9 AS warning FROM (
  SELECT count(*) AS n_findings,
         CASE WHEN count(*) = 0 THEN 1.0 ELSE greatest(0.0, 1.0 - count(*) * 0.05) END AS score FROM {_TEXT_FIND} f) x""")
def q_v_text_score(spark, sf):
    return verify.completeness(_text_findings(spark, sf))


def _kind(kind: str):
    def q(spark, sf):
        from pyspark.sql import functions as F
        return verify.findings(fixture(spark, sf, "fx_products")).filter(F.col("kind") == kind).select("row_id")
    return q


for _key, _kind_name in [("v_short_names", "missing_product_indicators"),
                         ("v_missing_price", "missing_price_indicators"),
                         ("v_low_confidence", "missing_category_indicators")]:
    register(_key, P, f"SELECT row_id FROM {_FIND} f WHERE kind = '{_kind_name}'")(_kind(_kind_name))
