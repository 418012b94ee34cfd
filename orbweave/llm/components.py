"""Connected components of an undirected graph by alternating large-star and small-star steps.

Each step is a grouped minimum (combined map-side) and an equi-join that adaptive execution
can split, so a node with a third of all links never meets in one task. No link reaches the
driver; the driver sees one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node around it."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. Links come as (larger, smaller)."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reachable.

    links: two columns of one orderable type. Null ends and self-links are ignored; repeats count once.
    An empty table gives an empty result.
    """
    a, b = F.col(a), F.col(b)
    now = written(links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    seen = _mark(now)
    while seen[0]:  # rounds grow with the logarithm of the longest chain, and each one that changes something brings the end nearer
        new = written(_small_star(_large_star(now)).distinct(), "links")
        mark = _mark(new)
        discard(now)
        now = new
        if mark == seen:
            break
        seen = mark
    # Every link is now (node, smallest node of its component).
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(links: DataFrame) -> tuple:
    """Count and checksum; equal marks mean equal link sets."""
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a", F.lit(1)).cast("decimal(38,0)"))).head()
    return tuple(row)
