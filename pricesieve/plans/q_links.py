"""Registered queries for links, URL tests, the crawl frontier and the fetch log (group B)."""
from __future__ import annotations

from pyspark.sql import functions as F

from pricesieve.operators import crawl, links
from pricesieve.plans import sqlfrag as S
from pricesieve.plans.fixtures import SITE_PAGES, fixture
from pricesieve.plans.registry import register
from pricesieve.sources.tables import read_table

_VAL = links.HREF_VALUE


def _raw_sql() -> str:
    val = " || ".join(f"regexp_extract(tag, {S.q(_VAL)}, {k})" for k in (1, 2, 3))
    return f"""(SELECT page_id, base_url, pos, href FROM (
  SELECT page_id, url AS base_url, i - 1 AS pos, {S.unescape(f'({val})')} AS href
  FROM (SELECT page_id, url, regexp_extract_all(html, {S.q(links.HREF_RE)}) AS tags FROM pages) p,
       generate_series(1, len(tags)) AS g(i),
       LATERAL (SELECT tags[i] AS tag) t) x
 WHERE NOT starts_with(href, '#'))"""


def _abs_sql(src: str) -> str:
    return f"""(SELECT *, CASE WHEN regexp_matches(href, '^https?://') THEN href
                     ELSE {S.urljoin('base_url', 'href')} END AS url FROM {src} r)"""


def _raw(spark, sf):
    return links.links_raw(read_table(spark, sf, "pages"))


@register("links_raw", [], f"SELECT * FROM {_raw_sql()} r")
def q_links_raw(spark, sf):
    return _raw(spark, sf)


@register("links_absolute", ["fx_hrefs"], f"""
SELECT page_id, base_url, pos, href, url FROM {_abs_sql('fx_hrefs')} a WHERE NOT starts_with(href, '#')
UNION ALL SELECT page_id, base_url, pos + 1000, href, url FROM {_abs_sql(_raw_sql())} b""")
def q_links_absolute(spark, sf):
    fx = fixture(spark, sf, "fx_hrefs").filter(~F.col("href").startswith("#")).select("page_id", "base_url", "pos", "href")
    raw = _raw(spark, sf).withColumn("pos", F.col("pos") + 1000)
    return links.links_absolute(fx.unionByName(raw))


_DISTINCT = f"""(SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, norm_url ORDER BY pos) AS rn
  FROM (SELECT *, split_part(url, '#', 1) AS norm_url FROM {_abs_sql(_raw_sql())} a) b) c WHERE rn = 1)"""


@register("links_distinct", [], f"SELECT * FROM {_DISTINCT} d")
def q_links_distinct(spark, sf):
    return links.links_distinct(links.links_absolute(_raw(spark, sf)))


@register("links_same_domain", [], f"""
SELECT *, {S.url_part("split_part(url, '#', 1)", 2)} = {S.url_part("split_part(base_url, '#', 1)", 2)} AS same_domain
FROM {_DISTINCT} d""")
def q_links_same_domain(spark, sf):
    return links.links_same_domain(links.links_distinct(links.links_absolute(_raw(spark, sf))))


def _strict(u, ct="content_type", cd="content_disposition"):
    ct, cd = f"lower(coalesce({ct}, ''))", f"lower(coalesce({cd}, ''))"
    return f"""(CASE WHEN {u} IS NULL OR {u} = '' OR starts_with({u}, 'mailto:') OR starts_with({u}, 'tel:') THEN false
      ELSE ends_with(lower({u}), '.pdf') OR contains({ct}, 'application/pdf')
           OR (contains({cd}, 'filename=') AND contains({cd}, '.pdf')) END)"""


@register("pdf_url_strict", ["fx_hrefs"], f"""
SELECT page_id, pos, url, {_strict('url')} AS is_pdf FROM {_abs_sql('fx_hrefs')} a""")
def q_pdf_url_strict(spark, sf):
    a = links.links_absolute(fixture(spark, sf, "fx_hrefs"))
    return a.select("page_id", "pos", "url",
                    links.pdf_url_strict(F.col("url"), F.col("content_type"), F.col("content_disposition")).alias("is_pdf"))


@register("pdf_url_loose", ["fx_hrefs"], f"""
SELECT page_id, pos, url,
  CASE WHEN url IS NULL OR url = '' THEN false
       ELSE ends_with(lower(url), '.pdf') OR ends_with(lower({S.url_part('url', 3)}), '.pdf')
            OR contains(lower({S.url_part('url', 3)}), '/pdf/') OR contains({S.url_part('url', 4)}, 'download=pdf')
            OR contains(lower(coalesce(content_type, '')), 'application/pdf') END AS is_pdf
FROM {_abs_sql('fx_hrefs')} a""")
def q_pdf_url_loose(spark, sf):
    a = links.links_absolute(fixture(spark, sf, "fx_hrefs"))
    return a.select("page_id", "pos", "url", links.pdf_url_loose(F.col("url"), F.col("content_type")).alias("is_pdf"))


@register("pdf_links", ["fx_hrefs"], f"""
SELECT *, contains(lower(url), 'menu') AS is_menu FROM (
  SELECT page_id, base_url, pos, href, content_type, content_disposition,
         CASE WHEN regexp_matches(href, '^(https?://|mailto:|tel:)') THEN href
              ELSE {S.urljoin("CASE WHEN regexp_matches(base_url, '^https?://') THEN base_url ELSE 'https://' || base_url END", 'href')}
         END AS url
  FROM fx_hrefs WHERE NOT starts_with(href, '#')) a
WHERE NOT (starts_with(url, 'mailto:') OR starts_with(url, 'tel:')) AND {_strict('url')}""")
def q_pdf_links(spark, sf):
    fx = fixture(spark, sf, "fx_hrefs").filter(~F.col("href").startswith("#"))
    return links.pdf_links(fx)


@register("fetch_outcome", ["fx_fetch_log"], """
WITH a AS (
  SELECT *, status = 'ok' AND length(coalesce(text, '')) >= 500 AS good FROM fx_fetch_log),
b AS (SELECT *, sum(CASE WHEN good THEN 0 ELSE 1 END) OVER (PARTITION BY url ORDER BY attempt
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fails FROM a),
d AS (SELECT url, min(attempt) AS att FROM b WHERE good OR fails >= 3 GROUP BY url),
r AS (SELECT b.url, CASE WHEN b.status = 'ok' THEN 'accepted' ELSE 'dropped' END AS outcome, b.attempt,
             CASE WHEN b.status = 'ok' THEN b.text END AS content
      FROM b JOIN d ON b.url = d.url AND b.attempt = d.att),
u AS (SELECT url, max(attempt) AS last_attempt FROM fx_fetch_log GROUP BY url)
SELECT u.url, coalesce(r.outcome, 'retry') AS outcome, coalesce(r.attempt, u.last_attempt) AS attempt, r.content
FROM u LEFT JOIN r ON u.url = r.url""")
def q_fetch_outcome(spark, sf):
    return links.fetch_outcome(fixture(spark, sf, "fx_fetch_log"))


# ------------------------------------------------------------------ crawl
MAX_PAGES = 50
#: Pages of a crawl in the visited table; crawls grow in number with the pages.
CRAWL_PAGES = 50
_URL = "'https://h' || CAST(p_partkey % 3 AS VARCHAR) || '.example.com/p/' || CAST(p_partkey AS VARCHAR)"


@register("crawl_bfs", ["fx_links"], f"""
WITH RECURSIVE starts AS (SELECT p_partkey AS crawl_id, {_URL} AS start_url FROM part),
walk(crawl_id, url, depth, path) AS (
  SELECT crawl_id, start_url, 0, CAST([] AS INTEGER[]) FROM starts
  UNION ALL
  SELECT w.crawl_id, l.dst, w.depth + 1, list_append(w.path, l.pos)
  FROM walk w JOIN fx_links l ON split_part(w.url, '#', 1) = l.src WHERE w.depth < 5),
best AS (SELECT crawl_id, url, min(depth) AS depth FROM walk GROUP BY ALL),
canon AS (SELECT w.crawl_id, w.url, w.depth, min(w.path) AS path FROM walk w
          JOIN best b ON w.crawl_id = b.crawl_id AND w.url = b.url AND w.depth = b.depth GROUP BY ALL),
ranked AS (SELECT crawl_id, url, depth, row_number() OVER (PARTITION BY crawl_id ORDER BY depth, path) - 1 AS rank
           FROM canon)
SELECT * FROM ranked WHERE rank < {MAX_PAGES}""")
def q_crawl_bfs(spark, sf):
    part = read_table(spark, sf, "part")
    url = F.concat(F.lit("https://h"), (F.col("p_partkey") % 3).cast("string"), F.lit(".example.com/p/"),
                   F.col("p_partkey").cast("string"))
    starts = part.select(F.col("p_partkey").alias("crawl_id"), url.alias("start_url"))
    return crawl.crawl_bfs(starts, fixture(spark, sf, "fx_links"), max_pages=MAX_PAGES)


_SITE_STARTS = f"""SELECT DISTINCT CAST(floor(p_partkey / {SITE_PAGES}) AS BIGINT) AS crawl_id,
  'https://s' || CAST(CAST(floor(p_partkey / {SITE_PAGES}) AS BIGINT) AS VARCHAR) || '.example.com/p/1' AS start_url FROM part"""


def _queue_sql(same_domain: bool = False, normalised: bool = False) -> str:
    """The first-in first-out queue itself: one step takes one URL and appends its new links."""
    ident = "split_part(dst, '#', 1)" if normalised else "dst"
    host = S.url_part("split_part({}, '#', 1)", 2).format
    asked = "x.host = q.host AND " if same_domain else ""
    news = f"list_filter(coalesce(l.ds, []), lambda x: {asked}NOT list_contains(q.ids, x.id))"
    return f"""
WITH RECURSIVE once AS (SELECT *, {ident} AS id, {host('dst')} AS host FROM fx_site_links
    QUALIFY row_number() OVER (PARTITION BY src, {ident} ORDER BY pos) = 1),
ll AS (SELECT src, list({{'u': dst, 'id': id, 'host': host}} ORDER BY pos) AS ds FROM once GROUP BY src),
st AS ({_SITE_STARTS}),
qu AS (SELECT crawl_id, CAST(0 AS BIGINT) AS n, {host('start_url')} AS host, [start_url] AS urls, [start_url] AS ids,
              [CAST(0 AS BIGINT)] AS depths FROM st
       UNION ALL
       SELECT crawl_id, n + 1, host, list_concat(urls, list_transform(news, lambda x: x.u)),
              list_concat(ids, list_transform(news, lambda x: x.id)),
              list_concat(depths, list_transform(news, lambda x: depths[n + 1] + 1))
       FROM (SELECT q.*, {news} AS news FROM qu q LEFT JOIN ll l ON l.src = split_part(q.urls[q.n + 1], '#', 1)
             WHERE q.n < len(q.urls)) s)
SELECT crawl_id, urls[i] AS url, depths[i] AS depth, i - 1 AS rank FROM qu, generate_series(1, len(urls)) AS g(i)
WHERE n = len(urls)"""


def _site_crawl(spark, sf, **form):
    links_ = fixture(spark, sf, "fx_site_links")
    site = F.floor(F.col("p_partkey") / SITE_PAGES)
    starts = read_table(spark, sf, "part").select(
        site.alias("crawl_id"),
        F.concat(F.lit("https://s"), site.cast("string"), F.lit(".example.com/p/1")).alias("start_url")).distinct()
    return crawl.crawl_bfs(starts, links_, **form)


@register("crawl_all", ["fx_site_links"], _queue_sql())
def q_crawl_all(spark, sf):
    """B8 without a page cap: one crawl per site, every page that links lead to."""
    return _site_crawl(spark, sf)


@register("crawl_same_domain", ["fx_site_links"], _queue_sql(same_domain=True))
def q_crawl_same_domain(spark, sf):
    """B8 on the start's host only."""
    return _site_crawl(spark, sf, same_domain_only=True)


@register("crawl_normalised", ["fx_site_links"], _queue_sql(normalised=True))
def q_crawl_normalised(spark, sf):
    """B9's other form: URLs that differ by their fragment are one page."""
    return _site_crawl(spark, sf, normalize_fragments=True)


# ------------------------------------------------------------ crawl graph
def _visited(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id", "url").withColumn("crawl_id", F.floor(F.col("page_id") / CRAWL_PAGES))
    base = p.groupBy("crawl_id").agg(F.min_by("url", "page_id").alias("base_url"))
    return p.join(base, "crawl_id").select("crawl_id", "base_url", "url")


_CRAWL = f"CAST(floor(page_id / {CRAWL_PAGES}) AS BIGINT)"
_VISITED = f"""(SELECT p.crawl_id, b.base_url, p.url FROM (SELECT {_CRAWL} AS crawl_id, page_id, url FROM pages) p
  JOIN (SELECT {_CRAWL} AS crawl_id, arg_min(url, page_id) AS base_url FROM pages GROUP BY 1) b
  ON p.crawl_id = b.crawl_id)"""
_NL = S.url_part("split_part(url, '#', 1)", 2)
_BNL = S.url_part("split_part(base_url, '#', 1)", 2)


@register("crawl_nodes", [], f"""
SELECT DISTINCT crawl_id, base_url AS node, 'start' AS type FROM {_VISITED} v
UNION SELECT DISTINCT crawl_id, {_NL}, 'domain' FROM {_VISITED} v WHERE {_NL} <> {_BNL}
UNION SELECT DISTINCT crawl_id, url, 'url' FROM {_VISITED} v WHERE url <> base_url""")
def q_crawl_nodes(spark, sf):
    return links.crawl_nodes(_visited(spark, sf))


@register("crawl_edges", [], f"""
SELECT DISTINCT crawl_id, base_url AS src, {_NL} AS dst FROM {_VISITED} v WHERE {_NL} <> {_BNL}
UNION SELECT DISTINCT crawl_id, CASE WHEN {_NL} <> {_BNL} THEN {_NL} ELSE base_url END, url
FROM {_VISITED} v WHERE url <> base_url""")
def q_crawl_edges(spark, sf):
    return links.crawl_edges(_visited(spark, sf))


@register("urls_by_domain", [], f"""
WITH d AS (SELECT DISTINCT crawl_id, {_NL} AS domain, url FROM {_VISITED} v)
SELECT d.crawl_id, d.domain, d.url, c.n_urls FROM d
JOIN (SELECT crawl_id, domain, count(*) AS n_urls FROM d GROUP BY ALL) c USING (crawl_id, domain)""")
def q_urls_by_domain(spark, sf):
    return links.urls_by_domain(_visited(spark, sf))
