"""URL filter: sort-merge range join of URLs with host and path rules.

A host's canonical key has its labels reversed, each with a dot after it, so a rule's host and
all its subdomains are one interval of keys: those that start with the rule's key.  URLs are
range-sorted by key, path and id, so a hot host is split like any other run of rows.  Every
rule goes to the ranges its interval meets, and each range is swept in key order with a stack
of the active rules, which nest as prefixes do.  Of the active rules whose path starts the
URL's path the longest wins (then the one with the longer host, then ``block``).

Defined results: a null URL, or one without ``://``, has an empty host and path; URLs without a
rule get the default verdict; repeated rows are judged one by one; rules with a null host,
path or verdict are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_VERDICT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_key(host: Column) -> Column:
    """``www.example.org`` -> ``org.example.www.``; '' stays ''."""
    return F.when(host == "", "").otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def sweep(urls: list[tuple[str, str]], rules: list[tuple[str, str, str, str]]) -> list[tuple[str, str] | None]:
    """``urls``: (key, path) in key order; ``rules``: (key, host, path, verdict) in key order.
    Returns the (rule, verdict) of each URL, or None."""
    stack: list[tuple[str, list]] = []
    out, at, last = [], 0, None
    for key, path in urls:
        if key != last:
            while at < len(rules) and rules[at][0] <= key:
                rule_key, host, rule_path, verdict = rules[at]
                at += 1
                while stack and not rule_key.startswith(stack[-1][0]):
                    stack.pop()
                if not stack or stack[-1][0] != rule_key:
                    stack.append((rule_key, []))
                stack[-1][1].append((len(host + rule_path), len(host), verdict, rule_path, host + rule_path))
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            active, last = sorted((r for _, group in stack for r in group), reverse=True), key
        won = next((r for r in active if path.startswith(r[3])), None)
        out.append((won[4], won[2]) if won else None)
    return out


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """``pages`` (page_id, url) and ``rules`` (host, path, verdict) -> (page_id, host, path,
    rule, verdict)."""
    from pricesieve.llm.common import staged

    spark = pages.sparkSession
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    urls = urls.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    ranges = staged(urls.repartitionByRange("key", "path", "page_id").withColumn("part", F.spark_partition_id()), "urls")
    # one row per range
    bounds = [tuple(r) for r in ranges.groupBy("part").agg(F.min("key"), F.max("key")).collect()]
    shared = spark.sparkContext.broadcast(sorted(bounds, key=lambda b: (b[1], b[2])))

    def meet(batches):
        import bisect

        import pyarrow as pa

        parts = shared.value
        highs, lows = [b[2] for b in parts], [b[1] for b in parts]
        for b in batches:
            rows = []
            for r in b.to_pylist():
                i, end = bisect.bisect_left(highs, r["key"]), r["key"] + chr(0x10FFFF)
                while i < len(parts) and lows[i] <= end:
                    rows.append(r | {"part": parts[i][0]})
                    i += 1
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*b.schema, pa.field("part", pa.int32())]))

    rules = rules.select("host", "path", "verdict").dropna().withColumn("key", host_key(F.col("host")))
    dealt = rules.mapInArrow(meet, "host string, path string, verdict string, key string, part int")

    def run(urls, rules):
        import pyarrow as pa

        urls = urls.sort_by([("key", "ascending"), ("path", "ascending")])
        rules = rules.sort_by([("key", "ascending")]).to_pylist()
        found = sweep(list(zip(urls["key"].to_pylist(), urls["path"].to_pylist())),
                      [(r["key"], r["host"], r["path"], r["verdict"]) for r in rules])
        return pa.table({"page_id": urls["page_id"], "host": urls["host"], "path": urls["path"],
                         "rule": pa.array([f and f[0] for f in found], pa.string()),
                         "verdict": pa.array([f[1] if f else default for f in found], pa.string())})

    kind = dict(ranges.dtypes)["page_id"]
    return ranges.groupBy("part").cogroup(dealt.groupBy("part")).applyInArrow(
        run, f"page_id {kind}, host string, path string, rule string, verdict string")


#: The rules of the query: (host, path, verdict).
QUERY_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
               ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def oracle(rules=QUERY_RULES, default: str = DEFAULT_VERDICT) -> str:
    """DuckDB: every rule against every URL, the longest that fits."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return rf"""
WITH r(h, p, v) AS (VALUES {values}),
u AS (SELECT row_number() OVER () AS rid, page_id,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
k AS (SELECT rid, page_id,
  translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT k.rid, max_by(h || p, (length(h || p), length(h), v)) AS rule, max_by(v, (length(h || p), length(h), v)) AS verdict
  FROM k JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict FROM k LEFT JOIN f USING (rid)
"""
