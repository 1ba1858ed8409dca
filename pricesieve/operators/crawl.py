"""Breadth-first crawl frontier over a stored link table.

The original crawler pops URLs from a FIFO queue, visits each once and appends the
links of every visited page that are neither visited nor queued, until ``max_pages``
pages are visited.  Here the whole frontier of every crawl advances one level per
round with joins; the FIFO order is kept as an explicit ``rank``:
rank of a new URL = URLs already seen + its position among the level's new URLs,
ordered by (parent rank, link position).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricesieve.functions.urls import netloc, strip_fragment
from pricesieve.session import ensure_checkpoint_dir, materialize


def ordered_rank(df: DataFrame, group: str, major: str, minor: str, bucket: int = 1 << 16) -> DataFrame:
    """0-based ``rank`` of each row within ``group`` ordered by (major, minor), and ``n_group``, the
    rows of the group.

    Rows sharing (group, major) must be few (the links of one page); a group may be
    huge.  Offsets come from per-major counts, summed per bucket of majors and then
    within a bucket, so no window ever spans a whole group.
    """
    per_major = df.groupBy(group, major).agg(F.count(F.lit(1)).alias("_c"))
    per_major = per_major.withColumn("_b", F.floor(F.col(major) / bucket))
    per_bucket = per_major.groupBy(group, "_b").agg(F.sum("_c").alias("_bc"))
    wb = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("_boff", F.coalesce(F.sum("_bc").over(wb), F.lit(0))) \
        .withColumn("n_group", F.sum("_bc").over(Window.partitionBy(group)))
    wm = Window.partitionBy(group, "_b").orderBy(major).rowsBetween(Window.unboundedPreceding, -1)
    offs = per_major.join(per_bucket.select(group, "_b", "_boff", "n_group"), [group, "_b"]).select(
        group, major, "n_group", (F.col("_boff") + F.coalesce(F.sum("_c").over(wm), F.lit(0))).alias("_off")
    )
    w = Window.partitionBy(group, major).orderBy(minor)
    return (
        df.join(offs, [group, major])
        .withColumn("rank", F.col("_off") + F.row_number().over(w) - 1)
        .drop("_off")
    )


def crawl_bfs(starts: DataFrame, links: DataFrame, max_pages: int | None = None,
              same_domain_only: bool = False, normalize_fragments: bool = False,
              max_levels: int | None = None) -> DataFrame:
    """Visit order of every crawl.

    ``starts``: (crawl_id, start_url); ``links``: (src, pos, dst), the distinct links of
    each page in page order (``src`` without fragment).  Output (crawl_id, url, depth,
    rank) with rank < max_pages.  ``normalize_fragments`` makes 'x#a' and 'x' one URL
    (the crawler's other variant); by default URLs are compared as written.

    One round per level; each level is checkpointed once and the seen set is the union
    of the level tables, so no table is rewritten and lineage stays one level deep.  Candidates and
    seen URLs meet in one grouping, under a page cap dealt by crawl, so that the ranks need no
    further shuffle.  A row brings its crawl's count of seen URLs (and the start's host) along.
    """
    spark = starts.sparkSession
    ensure_checkpoint_dir(spark)
    capped = max_pages is not None
    key = "ident" if normalize_fragments else "url"  # what makes two URLs one page
    host = ["host"] if same_domain_only else []

    def with_key(df: DataFrame) -> DataFrame:
        return df.withColumn("ident", strip_fragment(F.col("url"))) if normalize_fragments else df

    first_level = starts.select("crawl_id", F.col("start_url").alias("url"), F.lit(0).alias("depth"),
                                F.lit(0).cast("long").alias("rank"), *[netloc(F.col("start_url")).alias(h) for h in host])
    if capped and max_pages <= 0:
        first_level = first_level.limit(0)
    # URLs seen so far per crawl (ranks are dense, so this is also the next free rank)
    n_first = F.count(F.lit(1)).over(Window.partitionBy("crawl_id"))
    levels = [materialize(with_key(first_level.withColumn("n_seen", n_first)))]
    # the link table is read once per level: store it once, hash-partitioned on the join key, with
    # what is asked of every link
    n_part = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lk = links.select("src", "pos", F.col("dst").alias("url"), *[netloc(F.col("dst")).alias("dst_host") for _ in host])
    lk = materialize(with_key(lk).repartition(n_part, "src"))
    names = list(dict.fromkeys([key, "url"]))
    frontier = levels[0]
    level = 0
    while max_levels is None or level < max_levels:
        f = frontier.filter(F.col("crawl_id").isNotNull()).select(
            "crawl_id", F.col("rank").alias("parent_rank"), "n_seen", strip_fragment(F.col("url")).alias("src"), *host)
        cand = f.join(lk, "src")
        for h in host:
            cand = cand.filter(F.col("dst_host") == F.col(h))
        cand = cand.select("crawl_id", *names, F.lit(True).alias("new"), "parent_rank", "pos", "n_seen", *host)
        # a missing URL is no page: it is never met again
        seen = [lv.filter(F.col(key).isNotNull()).select("crawl_id", *names, F.lit(False).alias("new")) for lv in levels]
        met = cand
        for lv in seen:
            met = met.unionByName(lv, allowMissingColumns=True)
        if capped:
            # a capped crawl has at most max_pages pages and max_pages x (links of a page) candidates
            met = met.repartition("crawl_id")
        best = F.struct("new", "parent_rank", "pos", *[c for c in names if c != key], "n_seen", *host)
        found = met.groupBy("crawl_id", key).agg(F.min(best).alias("f")).filter("f.new").select("crawl_id", key, "f.*")
        if capped:
            crawl = Window.partitionBy("crawl_id")
            ranked = found.withColumn("n_group", F.count(F.lit(1)).over(crawl)).withColumn(
                "rank", F.row_number().over(crawl.orderBy("parent_rank", "pos")) - 1)
        else:
            ranked = ordered_rank(found, "crawl_id", "parent_rank", "pos")
        new = ranked.select(
            "crawl_id", "url", F.lit(level + 1).alias("depth"), (F.col("n_seen") + F.col("rank")).alias("rank"), *host,
            (F.col("n_seen") + F.col("n_group")).alias("n_seen"), *[c for c in names if c != "url"])
        if capped:
            new = new.filter(F.col("rank") < max_pages)
        new = materialize(new)
        if new.isEmpty():
            break
        levels.append(new)
        # a crawl that has visited max_pages pages adds nothing more: stop expanding it
        frontier = new.filter(F.col("n_seen") < max_pages) if capped else new
        if capped and frontier.isEmpty():
            break
        level += 1
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out.select("crawl_id", "url", "depth", "rank")
