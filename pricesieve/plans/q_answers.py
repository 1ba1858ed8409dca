"""Registered queries for stored model answers and category validation."""
from __future__ import annotations

from pyspark.sql import functions as F

from pricesieve import constants as K
from pricesieve.operators import answers
from pricesieve.plans import sqlfrag as S
from pricesieve.plans.fixtures import fixture
from pricesieve.plans.registry import register


def unfence_sql(x: str) -> str:
    t = S.strip(x)
    return S.strip(f"""(CASE WHEN contains({t}, '```json') THEN split_part(split_part({t}, '```json', 2), '```', 1)
                      WHEN contains({t}, '```') THEN split_part({t}, '```', 2) ELSE {t} END)""")


@register("unfence", ["fx_product_answers"], f"SELECT chunk_id, {unfence_sql('response')} AS answer FROM fx_product_answers")
def q_unfence(spark, sf):
    a = fixture(spark, sf, "fx_product_answers")
    return a.select("chunk_id", answers.unfence(F.col("response")).alias("answer"))


def tags_sql() -> str:
    return f"""
WITH a AS (SELECT chunk_id, url, {unfence_sql('response')} AS j FROM fx_tag_answers),
b AS (SELECT *, coalesce(json_valid(j), false) AND starts_with(j, '{{') AS ok FROM a)
SELECT chunk_id, url,
  CASE WHEN ok THEN coalesce(TRY_CAST(json_extract(j, '$.has_product_info') AS BOOLEAN), false) ELSE false END
    AS has_product_info,
  CASE WHEN ok THEN coalesce(TRY_CAST(json_extract(j, '$.has_price_info') AS BOOLEAN), false) ELSE false END
    AS has_price_info,
  CASE WHEN ok THEN coalesce(TRY_CAST(json_extract(j, '$.confidence') AS DOUBLE), 0.0) ELSE 0.0 END AS confidence,
  CASE WHEN ok THEN coalesce(json_extract_string(j, '$.reasoning'), '{K.NO_REASONING}')
       ELSE '{K.TAG_PARSE_FAILED}' END AS reasoning
FROM b"""


@register("tags", ["fx_tag_answers"], tags_sql())
def q_tags(spark, sf):
    return answers.tags(fixture(spark, sf, "fx_tag_answers"))


_ITEMS = f"""
a AS (SELECT chunk_id, url, text, {unfence_sql('response')} AS j FROM fx_product_answers),
b AS (SELECT chunk_id, url, text,
             CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]')
                  WHEN json_type(j) = 'OBJECT' THEN [CAST(j AS JSON)] END AS items
      FROM a WHERE coalesce(json_valid(j), false)),
c AS (SELECT chunk_id, url, text, i - 1 AS item_no, items[i] AS it FROM b, generate_series(1, len(items)) AS g(i)),
d AS (SELECT chunk_id, item_no, text, url AS source_url,
             {', '.join(f"coalesce(json_extract_string(it, '$.{k}'), {S.q(v)}) AS {k}" for k, v in K.PRODUCT_DEFAULTS)}
      FROM c),
items AS (SELECT * EXCLUDE (price),
                 CASE WHEN contains(lower(price), 'free') THEN 'Free' END AS original_price,
                 CASE WHEN contains(lower(price), 'free') THEN '$0' ELSE price END AS price FROM d)"""


@register("answers", ["fx_product_answers"], f"WITH {_ITEMS} SELECT * EXCLUDE (text) FROM items")
def q_answers(spark, sf):
    return answers.answer_items(fixture(spark, sf, "fx_product_answers")).drop("text")


@register("free_price", ["fx_product_answers"], f"""
WITH {_ITEMS} SELECT chunk_id, item_no, price, original_price FROM items WHERE original_price IS NOT NULL""")
def q_free_price(spark, sf):
    a = answers.answer_items(fixture(spark, sf, "fx_product_answers"))
    return a.filter(F.col("original_price").isNotNull()).select("chunk_id", "item_no", "price", "original_price")


def _list(words):
    return "[" + ", ".join(S.q(w) for w in words) + "]"


def _suggest_sql(tl: str) -> str:
    import re
    parts = []
    for mark in K.HEADING_MARKS:
        cand = f"""list_filter(list_transform(string_split({tl}, {S.q(mark)})[2:],
                     lambda p: substring({S.strip("split_part(p, '<', 1)")}, 1, 50)),
                   lambda h: length(h) > 3 AND length(h) < 50)"""
        parts.append(f"list_transform({cand}, lambda h: {{'raw': h, 'val': h}})")
    for p in K.SUGGESTION_PATTERNS:
        parts.append(f"""list_transform(list_filter(regexp_extract_all({tl}, {S.q(p)}, 1), lambda m: m <> ''),
                         lambda m: {{'raw': m, 'val': {S.strip('m')}}})""")
    allc = "list_concat(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0]
    # list_concat takes two arguments in older versions: nest them
    nested = parts[0]
    for p in parts[1:]:
        nested = f"list_concat({nested}, {p})"
    return f"""list_reduce({nested}, lambda acc, x: CASE WHEN list_contains(acc, x.raw) THEN acc
                 ELSE list_append(acc, x.val) END, CAST([] AS VARCHAR[]))[1:{K.MAX_SUGGESTIONS}]"""


def score_sql(src: str, indicators=K.CONTEXT_INDICATORS[:1]) -> str:
    cl, tl = "lower(category)", "lower(text)"
    words = f"list_filter(regexp_split_to_array({cl}, '{S.WS}+'), lambda w: w <> '')"
    matches = f"len(list_filter({words}, lambda w: length(w) > 3 AND instr({tl}, w) > 0))"
    ctx = f"""(CASE WHEN instr({tl}, {cl}) = 0 THEN '' ELSE substring({tl}, greatest(instr({tl}, {cl}) - 1 - 50, 0) + 1,
              least(length({tl}), instr({tl}, {cl}) - 1 + length({cl}) + 50) - greatest(instr({tl}, {cl}) - 1 - 50, 0)) END)"""
    seen = ' OR '.join(f"contains({ctx}, '{w}')" for w in indicators)
    confs = []
    for _, kws in K.DOMAIN_KEYWORDS:
        ch = " + ".join(f"CAST(instr({cl}, {S.q(k)}) > 0 AS INTEGER)" for k in kws)
        th = " + ".join(f"CAST(instr({tl}, {S.q(k)}) > 0 AS INTEGER)" for k in kws)
        confs.append(f"(CASE WHEN ({ch}) > 0 AND ({th}) > 0 THEN least(CAST(0.6 AS DOUBLE), "
                     f"CAST(0.3 AS DOUBLE) + (({th}) / {len(kws)} * CAST(0.3 AS DOUBLE))) END)")
    dom_conf = "greatest(CAST(0.0 AS DOUBLE), " + ", ".join(f"coalesce({c}, CAST(0.0 AS DOUBLE))" for c in confs) + ")"
    dom_valid = "greatest(" + ", ".join(f"coalesce({c} > 0.4, false)" for c in confs) + ")"
    return f"""(SELECT *,
  CASE WHEN empty_cat OR section THEN CAST(0.1 AS DOUBLE) ELSE conf END AS category_confidence,
  CASE WHEN empty_cat OR section THEN false ELSE valid END AS is_valid_category,
  CASE WHEN empty_cat THEN CAST([] AS VARCHAR[]) WHEN section THEN [{S.q(K.SITE_SECTION_SUGGESTION)}]
       WHEN conf < 0.5 THEN {_suggest_sql(tl)} ELSE CAST([] AS VARCHAR[]) END AS category_suggestions
FROM (SELECT *,
  category IS NULL OR category = '' OR {cl} = 'uncategorized' AS empty_cat,
  list_contains({_list(K.SITE_SECTIONS)}, {cl}) AS section,
  CASE WHEN instr({tl}, {cl}) > 0 THEN CASE WHEN {seen} THEN CAST(0.95 AS DOUBLE)
                                            ELSE CAST(0.8 AS DOUBLE) END
       WHEN {matches} > 0 THEN CAST(0.3 AS DOUBLE) + ({matches} / len({words})) * CAST(0.4 AS DOUBLE)
       ELSE {dom_conf} END AS conf,
  CASE WHEN instr({tl}, {cl}) > 0 THEN true WHEN {matches} > 0 THEN {matches} / len({words}) >= 0.5
       ELSE {dom_valid} END AS valid
  FROM {src} s) x)"""


@register("category_score", ["fx_product_answers"], f"""
WITH {_ITEMS}
SELECT chunk_id, item_no, category, category_confidence, is_valid_category, category_suggestions
FROM {score_sql('items')} sc""")
def q_category_score(spark, sf):
    it = answers.answer_items(fixture(spark, sf, "fx_product_answers"))
    sc = answers.category_score(it)
    return sc.select("chunk_id", "item_no", "category", "category_confidence", "is_valid_category", "category_suggestions")


@register("category_score_all", ["fx_product_answers"], f"""
WITH {_ITEMS}
SELECT chunk_id, item_no, category, category_confidence, is_valid_category, category_suggestions
FROM {score_sql('items', K.CONTEXT_INDICATORS)} sc""")
def q_category_score_all(spark, sf):
    """D25 with all context indicators."""
    sc = answers.category_score(answers.answer_items(fixture(spark, sf, "fx_product_answers")), first_indicator_only=False)
    return sc.select("chunk_id", "item_no", "category", "category_confidence", "is_valid_category", "category_suggestions")


@register("category_relabel", ["fx_product_answers"], f"""
WITH {_ITEMS}, sc AS (SELECT * FROM {score_sql('items')} x)
SELECT chunk_id, item_no, source_url, product_name, price, description, is_plan, plan_features, trial_info, provider,
       original_price,
       CASE WHEN category <> 'Uncategorized' AND category_confidence < 0.3 THEN 'Uncategorized (Low Confidence)'
            ELSE category END AS category,
       CASE WHEN category = 'Uncategorized' THEN CAST(0.0 AS DOUBLE) ELSE category_confidence END AS category_confidence,
       CASE WHEN category = 'Uncategorized' THEN false ELSE is_valid_category END AS is_valid_category,
       CASE WHEN category <> 'Uncategorized' AND category_confidence < 0.3 THEN category END AS category_original,
       CASE WHEN category <> 'Uncategorized' AND category_confidence < 0.3 THEN category_suggestions END
         AS category_suggestions
FROM sc""")
def q_category_relabel(spark, sf):
    it = answers.answer_items(fixture(spark, sf, "fx_product_answers"))
    return answers.category_relabel(it).drop("text")
