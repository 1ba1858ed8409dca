"""URL column helpers: split into parts, resolve a reference against a base."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# scheme, authority, path, query, fragment (RFC 3986 appendix B split)
URL_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
PARTS = {"scheme": 1, "netloc": 2, "path": 3, "query": 4, "fragment": 5}


def part(url: Column, name: str) -> Column:
    """One part of a URL ('' when absent); the scheme is lower-cased."""
    p = F.regexp_extract(url, "(?s)" + URL_RE, PARTS[name])
    return F.lower(p) if name == "scheme" else p


def strip_fragment(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


def netloc(url: Column) -> Column:
    """Authority of the URL without its fragment (port included, case kept)."""
    return part(strip_fragment(url), "netloc")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body`` (a lambda): keeps expressions linear in
    size where a value is needed several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _resolve_path(bpath: Column, hpath: Column) -> Column:
    """Python's urljoin path merge: base directory + reference, empty middle segments
    dropped for relative references, then '.' and '..' removed from left to right."""
    def merged(bp):
        base_dir = F.when(F.element_at(bp, -1) != "", F.slice(bp, 1, F.size(bp) - 1)).otherwise(bp)
        return let(F.concat(base_dir, F.split(hpath, "/")), lambda rel: F.when(
            F.size(rel) > 2,
            F.concat(F.slice(rel, 1, 1), F.filter(F.slice(rel, 2, F.size(rel) - 2), lambda x: x != ""),
                     F.slice(rel, -1, 1)),
        ).otherwise(rel))

    def resolve(segs):
        empty = F.array().cast("array<string>")
        resolved = F.aggregate(
            segs, empty,
            lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
        )
        resolved = F.when(F.element_at(segs, -1).isin(".", ".."), F.concat(resolved, F.array(F.lit("")))) \
            .otherwise(resolved)
        return let(F.array_join(resolved, "/"), lambda p: F.when(p == "", F.lit("/")).otherwise(p))

    segs = F.when(hpath.startswith("/"), F.split(hpath, "/")).otherwise(let(F.split(bpath, "/"), merged))
    return let(segs, resolve)


def urljoin_parts(base, bs, bn, bpath, bq, href, hs, hpath, hq, hf) -> Column:
    """urljoin from split parts; each part should be a plain column or lambda variable."""
    has_auth = href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://")
    tail = F.concat(F.when(hq != "", F.concat(F.lit("?"), hq)).otherwise(F.lit("")),
                    F.when(hf != "", F.concat(F.lit("#"), hf)).otherwise(F.lit("")))
    same_path = F.concat(bs, F.lit("://"), bn, bpath,
                         F.when(hq != "", F.concat(F.lit("?"), hq))
                         .when(bq != "", F.concat(F.lit("?"), bq)).otherwise(F.lit("")),
                         F.when(hf != "", F.concat(F.lit("#"), hf)).otherwise(F.lit("")))
    rp = let(_resolve_path(bpath, hpath), lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))
    joined = F.concat(bs, F.lit("://"), bn, rp, tail)
    return (
        F.when(href.isNull() | base.isNull(), F.lit(None))
        .when(href == "", base)
        .when((hs != "") & (hs != bs), href)
        .when(href.startswith("//"), F.concat(bs, F.lit(":"), href))
        .when(has_auth, F.concat(bs, F.lit(":"), F.regexp_extract(href, r"^[^:]*:(.*)$", 1)))
        .when(hpath == "", same_path)
        .otherwise(joined)
    )


def urljoin(base: Column, href: Column) -> Column:
    """Resolve ``href`` against ``base`` the way the standard library's urljoin does for
    http(s) bases: other schemes are kept, '//' takes the base scheme, an empty path keeps
    the base path (and query unless one is given), dot segments are removed.
    Each URL is split once (bound with :func:`let`)."""
    parts = F.struct(
        base.alias("b"), part(base, "scheme").alias("bs"), part(base, "netloc").alias("bn"),
        part(base, "path").alias("bp"), part(base, "query").alias("bq"), href.alias("h"),
        part(href, "scheme").alias("hs"), part(href, "path").alias("hp"), part(href, "query").alias("hq"),
        part(href, "fragment").alias("hf"),
    )
    return let(parts, lambda p: urljoin_parts(p["b"], p["bs"], p["bn"], p["bp"], p["bq"], p["h"], p["hs"], p["hp"],
                                              p["hq"], p["hf"]))


def with_urljoin(df, base: Column, href: Column, out: str, when=None):
    """Add ``out`` = urljoin(base, href); with ``when`` only those rows are resolved, the
    others keep ``href``."""
    j = urljoin(base, href)
    if when is not None:
        j = F.when(when, j).otherwise(href)
    return df.withColumn(out, j)
