"""Registered queries for deduplication (group E)."""
from __future__ import annotations

from pyspark.sql import functions as F

from pricesieve import constants as K
from pricesieve.operators import dedup, edits
from pricesieve.plans import q_answers  # noqa: F401  (its oracle is a part of the flagship's)
from pricesieve.plans.dedup_sql import leader_ctes, ratio_ctes, score_ctes
from pricesieve.plans.fixtures import fixture
from pricesieve.plans.registry import SQL, register

P = ["fx_products"]
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def _p(spark, sf):
    return fixture(spark, sf, "fx_products")


def _strip(x):
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_NPRICE = f"""CASE WHEN price IS NULL OR price = '' THEN NULL
     WHEN contains({_strip('lower(price)')}, 'free') THEN '$0'
     WHEN regexp_extract({_strip('lower(price)')}, '[0-9.]+', 0) <> ''
       THEN '$' || regexp_extract({_strip('lower(price)')}, '[0-9.]+', 0)
     ELSE {_strip('lower(price)')} END"""

_DUR = r"(\d+)\s*(minute|min|hour|hr)s?"
_NDUR = f"""CASE WHEN description IS NULL OR description = ''
            OR regexp_extract(lower(description), '{_DUR}', 1) = '' THEN ''
     WHEN contains(regexp_extract(lower(description), '{_DUR}', 2), 'hour')
       THEN regexp_extract(lower(description), '{_DUR}', 1) || ' hour'
     ELSE regexp_extract(lower(description), '{_DUR}', 1) || ' minute' END"""


@register("norm_price", P, f"SELECT row_id, {_NPRICE} AS n_price FROM fx_products")
def q_norm_price(spark, sf):
    return _p(spark, sf).select("row_id", dedup.norm_price(F.col("price")).alias("n_price"))


@register("norm_duration", P, f"SELECT row_id, {_NDUR} AS n_duration FROM fx_products")
def q_norm_duration(spark, sf):
    return _p(spark, sf).select("row_id", dedup.norm_duration(F.col("description")).alias("n_duration"))


def _nname(col: str) -> str:
    words = f"regexp_replace(regexp_replace({_strip(f'lower({col})')}, '[^\\w\\s-]', ' ', 'g'), '{_WS}+', ' ', 'g')"
    cut = f"regexp_replace({words}, '\\s*powered\\s*by\\s*\\w+\\s*$', '')"
    return f"CASE WHEN {col} IS NULL OR {col} = '' THEN '' ELSE {_strip(cut)} END"


@register("norm_name", P, f"SELECT row_id, {_nname('product_name')} AS n_name FROM fx_products")
def q_norm_name(spark, sf):
    return _p(spark, sf).select("row_id", dedup.norm_text(F.col("product_name")).alias("n_name"))


_WELLFORMED = """NOT (product_name IS NULL OR product_name = ''
  OR regexp_matches(product_name, '[A-Za-z]+\\s*-\\s*[A-Za-z]+\\s+Free.*\\d+\\s*minutes?\\s*Powered')
  OR (len(list_filter(regexp_split_to_array(product_name, '\\s+'), lambda w: w <> '')) > 10
      AND contains(lower(product_name), 'powered')))"""


@register("wellformed", P, f"SELECT * FROM fx_products WHERE {_WELLFORMED}")
def q_wellformed(spark, sf):
    p = _p(spark, sf)
    return p.filter(~dedup.is_malformed(F.col("product_name")))


_QUALITY = f"""(CASE WHEN coalesce(price <> '' AND price <> 'Price not found', false) THEN 3 ELSE 0 END
  + CASE WHEN coalesce(provider <> '', false) THEN 2 ELSE 0 END
  + CASE WHEN coalesce(length(description) > 10, false) THEN 1 ELSE 0 END
  + CASE WHEN ({_NDUR}) <> '' THEN 1 ELSE 0 END)"""


@register("quality", P, f"SELECT row_id, {_QUALITY} AS quality FROM fx_products")
def q_quality(spark, sf):
    p = _p(spark, sf)
    return p.select("row_id", dedup.quality(p).alias("quality"))


@register("quality_rank", P, f"""
SELECT row_id, quality, row_number() OVER (ORDER BY quality DESC, row_id) AS rank
FROM (SELECT row_id, {_QUALITY} AS quality FROM fx_products) q""")
def q_quality_rank(spark, sf):
    p = _p(spark, sf)
    return dedup.quality_rank(p)


def _prepared(src: str) -> str:
    return f"""pp AS (SELECT row_id, {_QUALITY} AS quality, {_nname('product_name')} AS n_name, {_NPRICE} AS n_price,
      CASE WHEN provider <> '' THEN {_nname('provider')} END AS n_provider, {_NDUR} AS n_duration
      FROM {src} WHERE {_WELLFORMED})"""


def _leaders(threshold: float, src: str = "fx_products") -> str:
    return f"WITH RECURSIVE {_prepared(src)}, {leader_ctes('pp', threshold)}"


@register("dedup_leaders", P, f"{_leaders(K.SIMILARITY_THRESHOLD)} SELECT * FROM ld")
def q_dedup_leaders(spark, sf):
    return dedup.dedup_leaders(_p(spark, sf), K.SIMILARITY_THRESHOLD)


@register("dedup_sweep", P, f"{_leaders(0.75)} SELECT * FROM ld")
def q_dedup_sweep(spark, sf):
    return dedup.dedup_leaders(_p(spark, sf), 0.75)


@register("dedup_sweep_90", P, f"{_leaders(0.9)} SELECT * FROM ld")
def q_dedup_sweep_90(spark, sf):
    return dedup.dedup_leaders(_p(spark, sf), 0.9)


@register("dedup_sweep_70", P, f"{_leaders(0.7)} SELECT * FROM ld")
def q_dedup_sweep_70(spark, sf):
    """The lowest threshold at which a name needs nothing but an equal price."""
    return dedup.dedup_leaders(_p(spark, sf), 0.7)


@register("dedup_sweep_60", P, f"{_leaders(0.6)} SELECT * FROM ld")
def q_dedup_sweep_60(spark, sf):
    return dedup.dedup_leaders(_p(spark, sf), 0.6)


@register("dedup_sweep_50", P, f"{_leaders(0.5)} SELECT * FROM ld")
def q_dedup_sweep_50(spark, sf):
    """The low end of the threshold's range."""
    return dedup.dedup_leaders(_p(spark, sf), 0.5)


@register("dedup_stats", P, f"""{_leaders(K.SIMILARITY_THRESHOLD)}
SELECT original, uniq AS "unique", original - uniq AS reduction,
       CASE WHEN original > 0 THEN round((original - uniq) / original * 100, 1) ELSE 0.0 END AS reduction_pct
FROM (SELECT (SELECT count(*) FROM fx_products) AS original, (SELECT count(*) FROM ld WHERE is_leader) AS uniq) n""")
def q_dedup_stats(spark, sf):
    p = _p(spark, sf)
    return edits.dedup_stats(p, dedup.deduplicate(p, K.SIMILARITY_THRESHOLD))


_ITEMS = f"""it AS (SELECT *, row_number() OVER (ORDER BY chunk_id, item_no) AS row_id FROM ({SQL['category_relabel']}) r)"""


@register("dedup_category_counts", ["fx_product_answers"], f"""
{_leaders(K.SIMILARITY_THRESHOLD, 'it').replace('WITH RECURSIVE', 'WITH RECURSIVE ' + _ITEMS + ',')}
SELECT category, count(*) AS n FROM it JOIN ld USING (row_id) WHERE is_leader GROUP BY category""")
def q_dedup_category_counts(spark, sf):
    from pricesieve.plans.flows import catalogue_category_counts
    return catalogue_category_counts(fixture(spark, sf, "fx_product_answers"))


@register("pair_scores")
def q_pair_scores(spark, sf):
    """Weighted scores of the candidate signature pairs (blocking at 0.8)."""
    p = dedup.prepare(_p(spark, sf))
    cols = ["n_name", "n_price", "n_provider", "n_duration"]
    return dedup.pair_scores(p.select(*cols).distinct(), K.SIMILARITY_THRESHOLD, dedup.signature_id(*cols))


def _key_sql(t: str) -> str:
    return f"({t}.n_name || '|' || coalesce({t}.n_price, '~') || '|' || coalesce({t}.n_provider, '~') || '|' || {t}.n_duration)"


@register("pair_links", P, f"""
WITH {_prepared('fx_products')}, {score_ctes('pp')}
SELECT least({_key_sql('a')}, {_key_sql('b')}) AS first, greatest({_key_sql('a')}, {_key_sql('b')}) AS second, score
FROM sc JOIN sg a ON a.sig = s1 JOIN sg b ON b.sig = s2 WHERE score >= CAST({K.SIMILARITY_THRESHOLD} AS DOUBLE)""")
def q_pair_links(spark, sf):
    """All signature pairs (and signatures with themselves) at or above the threshold, scored."""
    cols = ["n_name", "n_price", "n_provider", "n_duration"]
    # the signature itself is its id, so a pair brings both its keys
    sig = dedup.prepare(_p(spark, sf)).select(*cols).distinct()
    key = {s: F.concat(F.col(f"{s}.n_name"), F.lit("|"), F.coalesce(F.col(f"{s}.n_price"), F.lit("~")), F.lit("|"),
                       F.coalesce(F.col(f"{s}.n_provider"), F.lit("~")), F.lit("|"), F.col(f"{s}.n_duration")) for s in ("s1", "s2")}
    pairs = dedup.pair_scores(sig, K.SIMILARITY_THRESHOLD, F.struct(*cols)).filter(F.col("score") >= K.SIMILARITY_THRESHOLD)
    return pairs.select(F.least(*key.values()).alias("first"), F.greatest(*key.values()).alias("second"), "score")


@register("name_ratio", P, f"""
WITH {_prepared('fx_products')},
np AS (SELECT DISTINCT a.n_name AS x, b.n_name AS y FROM pp a JOIN pp b ON a.n_provider = b.n_provider AND a.n_name < b.n_name),
{ratio_ctes('np')}
SELECT x AS name1, y AS name2, name_sim FROM ns""")
def q_name_ratio(spark, sf):
    """Best of token-set, token-sort and plain ratio for distinct name pairs of a
    provider block."""
    from pricesieve.functions.similarity import name_similarity_udf
    p = dedup.prepare(_p(spark, sf)).select("n_provider", "n_name").filter(F.col("n_provider").isNotNull()).distinct()
    a, b = p.alias("a"), p.alias("b")
    pairs = a.join(b, (F.col("a.n_provider") == F.col("b.n_provider")) & (F.col("a.n_name") < F.col("b.n_name")))
    pairs = pairs.select(F.col("a.n_name").alias("name1"), F.col("b.n_name").alias("name2")).distinct()
    return pairs.withColumn("name_sim", name_similarity_udf("name1", "name2"))
