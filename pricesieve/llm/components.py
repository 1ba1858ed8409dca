"""Connected components of a link table by alternating large-star and small-star rounds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricesieve.llm.common import staged


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to its smallest neighbour (or itself)."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.join(least, "a").where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours and itself to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a")
    return (moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b): undirected links between long ids, self-links and repeats allowed.
    Returns (node, root): every node that has a link, with the smallest id it can reach.

    A round writes its links to the shared folder and is repeated until the links form
    stars.  Minima combine before the shuffle, so a node with many links is no hot group; the
    joins are plain equi-joins that adaptive execution splits.
    """
    links = (links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
             .distinct())
    links = staged(links, "links")
    state = None
    while True:
        new = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state or new[0] == 0:
            break
        state = new
        links = staged(_small_star(_large_star(links)), "links")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
