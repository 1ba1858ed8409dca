"""Registered queries for booking pages and external items."""
from __future__ import annotations

from pricesieve import constants as K
from pricesieve.operators import booking
from pricesieve.plans import sqlfrag as S
from pricesieve.plans.fixtures import fixture
from pricesieve.plans.registry import register


def _field_sql(card: str, tags, classes, exact=True) -> str:
    rx = S.q(booking.field_regex(tags, classes, exact))
    return f"(CASE WHEN regexp_extract({card}, {rx}, 0) <> '' THEN {S.strip(S.unescape(f'regexp_extract({card}, {rx}, 1)'))} END)"


def _cards_sql() -> str:
    st, st2 = S.q(booking.CARD_START), S.q(booking.CARD_START_FALLBACK)
    book = " OR ".join(f"contains(url, {S.q(w)})" for w in K.BOOKING_URL_WORDS)
    legal = " OR ".join(f"contains(lower(url), {S.q(w)})" for w in K.LEGAL_URL_WORDS)
    prov = _field_sql("card", K.PROVIDER_TAGS, K.PROVIDER_CLASSES)
    prov2 = _field_sql("card", K.PROVIDER_TAGS_2, K.PROVIDER_CLASSES_2)
    svc = _field_sql("card", K.SERVICE_TAGS, K.SERVICE_CLASSES)
    dur = _field_sql("card", None, K.DURATION_CLASSES + ['[^"]*minute'], False)
    pel = _field_sql("card", None, ["price", "cost"], False)
    txt = S.unescape("regexp_replace(card, '<[^>]*>', '', 'g')")
    return f"""
WITH p AS (SELECT page_id, url,
             CASE WHEN regexp_matches(html, {st}) THEN string_split(regexp_replace(html, {st}, chr(2) || '\\1', 'g'), chr(2))
                  ELSE string_split(regexp_replace(html, {st2}, chr(2) || '\\1', 'g'), chr(2)) END AS pieces
           FROM fx_booking_html WHERE {book}),
c AS (SELECT page_id, url, i - 1 AS card_no, pieces[i] AS card FROM p, generate_series(2, len(pieces)) AS g(i)),
f AS (SELECT page_id, url, card_no,
             CASE WHEN coalesce({prov}, '') <> '' THEN {prov} ELSE coalesce({prov2}, '') END AS provider,
             coalesce({svc}, 'Consultation') AS service,
             CASE WHEN coalesce({dur}, '') <> '' THEN {dur} ELSE regexp_extract({txt}, '(\\d+)\\s*minutes', 0) END
               AS duration,
             CASE WHEN {pel} IS NOT NULL THEN {pel}
                  WHEN regexp_matches({txt}, '\\$(\\d+)') THEN regexp_extract({txt}, '\\$(\\d+)', 0)
                  WHEN contains(lower({txt}), 'free') THEN 'Free' ELSE 'Price not found' END AS price
      FROM c),
k AS (SELECT *, {S.strip("regexp_replace(regexp_replace(service, '\\d+\\s*minutes', '', 'g'), '\\$\\d+', '', 'g')")} AS svc
      FROM f WHERE provider <> '' OR service <> 'Consultation')
SELECT page_id, card_no, CASE WHEN provider <> '' THEN provider || ' - ' || svc ELSE svc END AS product_name, price,
       CASE WHEN {legal} THEN 'Legal Services' ELSE 'Professional Services' END AS category,
       duration || CASE WHEN provider <> '' THEN ' with ' || provider ELSE '' END AS description,
       url AS source_url, provider
FROM k"""


@register("booking_cards", ["fx_booking_html"], _cards_sql())
def q_booking_cards(spark, sf):
    return booking.booking_cards(fixture(spark, sf, "fx_booking_html"))


def _booking_regex_sql() -> str:
    parts = []
    for i, p in enumerate(K.BOOKING_PATTERNS):
        rx = S.q("(?ism)" + p)
        parts.append(f"""SELECT page_id, url, t, {i} AS pattern_no, k - 1 AS match_no, pieces[2 * k] AS m,
       length(array_to_string(pieces[1:2 * k - 1], '')) AS start
FROM (SELECT *, string_split(regexp_replace(t, {rx}, chr(5) || '\\0' || chr(5), 'g'), chr(5)) AS pieces FROM t0) x,
     generate_series(1, CAST(floor((len(pieces) - 1) / 2) AS BIGINT)) AS g(k)""")
    grp = {}
    for k in (1, 2, 3, 4):
        cases = " ".join(f"WHEN {i} THEN regexp_extract(m, {S.q('(?ism)^' + p)}, {k})"
                         for i, p in enumerate(K.BOOKING_PATTERNS))
        grp[k] = f"(CASE pattern_no {cases} END)"
    legal = " OR ".join(f"contains(lower(url), {S.q(w)})" for w in K.LEGAL_URL_WORDS)
    win = "substring(t, greatest(start - 100, 0) + 1, least(length(t), start + 100) - greatest(start - 100, 0))"
    return f"""
WITH t0 AS (SELECT page_id, url, regexp_replace(html, '&[a-z]+;', ' ', 'g') AS t FROM fx_booking_html),
m AS ({' UNION ALL '.join(parts)}),
f AS (SELECT page_id, url, match_no, pattern_no,
             {S.strip(grp[1])} AS provider,
             CASE WHEN {grp[2]} <> '' THEN {S.strip(grp[2])} ELSE 'Consultation' END AS service,
             CASE WHEN pattern_no < 2 THEN {S.strip(grp[3])} ELSE '' END AS duration,
             {grp[4]} AS g4, {win} AS win FROM m),
p AS (SELECT *, CASE WHEN pattern_no = 0 AND g4 <> '' THEN '$' || g4
                     WHEN contains(lower(service), 'free') THEN 'Free'
                     WHEN regexp_matches(win, '\\$(\\d+)') THEN regexp_extract(win, '\\$(\\d+)', 0)
                     ELSE 'Price not found' END AS price FROM f)
SELECT page_id, pattern_no, match_no, CASE WHEN provider <> '' THEN provider || ' - ' || service ELSE service END AS product_name,
       price, CASE WHEN {legal} THEN 'Legal Services' ELSE 'Professional Services' END AS category,
       duration || CASE WHEN provider <> '' THEN ' with ' || provider ELSE '' END AS description,
       url AS source_url, provider
FROM p"""


@register("booking_regex", ["fx_booking_html"], _booking_regex_sql())
def q_booking_regex(spark, sf):
    return booking.booking_regex(fixture(spark, sf, "fx_booking_html"))


@register("item_map", ["fx_ext_items"], """
SELECT item_id, coalesce(name, 'Unknown') AS product_name, coalesce(price, 'Price not found') AS price,
       coalesce(category, 'Uncategorized') AS category, coalesce(description, 'No description available') AS description,
       url AS source_url, coalesce(category, 'Uncategorized') AS original_category, 0.8 AS category_confidence,
       true AS is_valid_category, 'ScrapeGraphAI' AS extracted_by, brand, availability, image_url, sku
FROM fx_ext_items""")
def q_item_map(spark, sf):
    return booking.item_map(fixture(spark, sf, "fx_ext_items"))
