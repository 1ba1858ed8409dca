"""Links, URL tests and crawl bookkeeping on stored pages (group B)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricesieve import constants as K
from pricesieve.functions.html import unescape
from pricesieve.functions.urls import netloc, part, strip_fragment, with_urljoin

# <a ...href=...> with a double-quoted, single-quoted or bare value
HREF_RE = r"""(?is)<a\s[^>]*?\bhref\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)"""
HREF_VALUE = r"""(?is)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))$"""


def links_raw(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """B1: every <a href> of a page in document order (entities decoded), anchors ('#...') skipped."""
    tags = F.regexp_extract_all(F.col(html), F.lit(HREF_RE), 0)
    out = pages.select(key, F.col(url).alias("base_url"), F.posexplode(tags).alias("pos", "tag"))
    val = F.concat(
        F.regexp_extract("tag", HREF_VALUE, 1), F.regexp_extract("tag", HREF_VALUE, 2),
        F.regexp_extract("tag", HREF_VALUE, 3),
    )
    out = out.select(key, "base_url", "pos", unescape(val).alias("href"))
    return out.filter(~F.col("href").startswith("#"))


def links_absolute(links: DataFrame) -> DataFrame:
    """B2/B7d: http(s) hrefs kept, others resolved against the page URL."""
    h = F.col("href")
    return with_urljoin(links, F.col("base_url"), h, "url", when=~h.rlike("^https?://"))


def links_distinct(links: DataFrame, key: str = "page_id") -> DataFrame:
    """Per page the first link of each fragment-free URL, in order; the original
    URL (with its fragment) is emitted."""
    w = Window.partitionBy(key, "norm_url").orderBy("pos")
    d = links.withColumn("norm_url", strip_fragment(F.col("url")))
    return d.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def same_domain(a, b):
    """Equal authority (port included) after fragment removal."""
    return netloc(a) == netloc(b)


def links_same_domain(links: DataFrame) -> DataFrame:
    return links.withColumn("same_domain", same_domain(F.col("url"), F.col("base_url")))


def pdf_url_strict(url, content_type=None, content_disposition=None):
    """No mailto:/tel:; '.pdf' suffix; else a PDF content type, or a PDF file name in
    the content disposition.  Missing headers read as ''."""
    ct = F.lower(F.coalesce(content_type, F.lit(""))) if content_type is not None else F.lit("")
    cd = F.lower(F.coalesce(content_disposition, F.lit(""))) if content_disposition is not None else F.lit("")
    ok = (
        F.lower(url).endswith(K.PDF_SUFFIX)
        | ct.contains(K.PDF_CONTENT_TYPE)
        | (cd.contains("filename=") & cd.contains(".pdf"))
    )
    bad = url.isNull() | (url == "") | url.startswith("mailto:") | url.startswith("tel:")
    return F.when(bad, F.lit(False)).otherwise(ok)


def pdf_url_loose(url, content_type=None):
    """B7b: '.pdf' suffix of the URL or of its path; '/pdf/' in the path; 'download=pdf'
    in the query; else a PDF content type."""
    path = F.lower(part(url, "path"))
    ct = F.lower(F.coalesce(content_type, F.lit(""))) if content_type is not None else F.lit("")
    ok = (
        F.lower(url).endswith(K.PDF_SUFFIX) | path.endswith(K.PDF_SUFFIX) | path.contains("/pdf/")
        | part(url, "query").contains("download=pdf") | ct.contains(K.PDF_CONTENT_TYPE)
    )
    return F.when(url.isNull() | (url == ""), F.lit(False)).otherwise(ok)


def with_scheme(url):
    """Prefix 'https://' when the URL has no http(s) scheme."""
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def pdf_links(links: DataFrame) -> DataFrame:
    """Links of a page that are PDFs (duplicates kept); mailto:/tel: dropped;
    routed to menu processing when 'menu' occurs in the lower-cased URL."""
    h = F.col("href")
    keep_raw = h.rlike("^(https?://|mailto:|tel:)")
    out = with_urljoin(links, with_scheme(F.col("base_url")), h, "url", when=~keep_raw)
    out = out.filter(~(F.col("url").startswith("mailto:") | F.col("url").startswith("tel:")))
    ct = F.col("content_type") if "content_type" in links.columns else None
    cd = F.col("content_disposition") if "content_disposition" in links.columns else None
    out = out.filter(pdf_url_strict(F.col("url"), ct, cd))
    return out.withColumn("is_menu", F.lower("url").contains(K.MENU_WORD))


# ------------------------------------------------------------ fetch log
def fetch_outcome(log: DataFrame, max_retries: int = K.MAX_RETRIES, thin: int = K.THIN_CONTENT_CHARS) -> DataFrame:
    """Per URL, attempts in order.  An 'ok' attempt with at least ``thin`` characters
    is accepted; a thin answer or an error is a failure.  The attempt at which the
    failures reach ``max_retries`` decides: a thin answer is then accepted anyway, an error
    drops the URL.  Without a decision the URL is still queued ('retry').  Attempts of a URL
    differ in their number.  The decision reads no text; only the accepted attempt's is joined."""
    ok = F.col("status") == "ok"
    good = ok & (F.length(F.coalesce("text", F.lit(""))) >= thin)
    w = Window.partitionBy("url").orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    a = log.select("url", "attempt", ok.alias("ok"), good.alias("good"))
    a = a.withColumn("fails", F.sum((~F.col("good")).cast("int")).over(w))
    deciding = F.col("good") | (F.col("fails") >= max_retries)
    res = a.groupBy("url").agg(F.min(F.when(deciding, F.struct("attempt", "ok"))).alias("d"),
                               F.max("attempt").alias("last_attempt"))
    res = res.select(
        "url", F.when(F.col("d").isNull(), "retry").when(F.col("d.ok"), "accepted").otherwise("dropped").alias("outcome"),
        F.coalesce("d.attempt", "last_attempt").alias("attempt"))
    texts = log.select("url", "attempt", F.col("text").alias("content"), F.lit("accepted").alias("outcome"))
    return res.join(texts, ["url", "attempt", "outcome"], "left").select("url", "outcome", "attempt", "content")


# ----------------------------------------------------------- crawl graph
def crawl_nodes(visited: DataFrame) -> DataFrame:
    """Per crawl the start node, one node per foreign domain, one per other URL.
    ``visited`` holds (crawl_id, base_url, url)."""
    d = visited.withColumn("domain", netloc(F.col("url"))).withColumn("base_domain", netloc(F.col("base_url")))
    start = visited.select("crawl_id", F.col("base_url").alias("node"), F.lit("start").alias("type"))
    doms = d.filter(F.col("domain") != F.col("base_domain")).select("crawl_id", F.col("domain").alias("node"),
                                                                      F.lit("domain").alias("type"))
    urls = d.filter(F.col("url") != F.col("base_url")).select("crawl_id", F.col("url").alias("node"),
                                                                F.lit("url").alias("type"))
    return start.unionByName(doms).unionByName(urls).distinct()


def crawl_edges(visited: DataFrame) -> DataFrame:
    """Start -> domain for foreign domains; start -> URL on the start's domain;
    domain -> URL otherwise."""
    d = visited.withColumn("domain", netloc(F.col("url"))).withColumn("base_domain", netloc(F.col("base_url")))
    foreign = F.col("domain") != F.col("base_domain")
    to_dom = d.filter(foreign).select("crawl_id", F.col("base_url").alias("src"), F.col("domain").alias("dst"))
    u = d.filter(F.col("url") != F.col("base_url"))
    to_url = u.select("crawl_id", F.when(foreign, F.col("domain")).otherwise(F.col("base_url")).alias("src"),
                      F.col("url").alias("dst"))
    return to_dom.unionByName(to_url).distinct()


def urls_by_domain(visited: DataFrame) -> DataFrame:
    """URLs grouped by domain, as one row per (domain, url) with the domain's count
    (a long table: a large domain is never gathered into one row)."""
    d = visited.select("crawl_id", netloc(F.col("url")).alias("domain"), "url").distinct()
    counts = d.groupBy("crawl_id", "domain").agg(F.count(F.lit(1)).alias("n_urls"))
    return d.join(counts, ["crawl_id", "domain"])
