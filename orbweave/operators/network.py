"""Expansion of a follow network from a seed, with a limit on how many followers a kept user has.

follows: src (follower), dst (followed). profiles: handle, followers_count; a user without a profile counts as having no followers.
Joins are left to the optimizer: small sides are broadcast by their size, skewed keys are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_limit(users: DataFrame, profiles: DataFrame, limit: int, col: str = "src") -> DataFrame:
    """users with followers (0 where unknown) and keep. A limit of 0 or less keeps everyone."""
    out = users.join(profiles.select(F.col("handle").alias(col), F.col("followers_count").alias("followers")), col, "left").withColumn("followers", F.coalesce("followers", F.lit(0)))
    return out.withColumn("keep", F.lit(True) if limit <= 0 else F.col("followers") <= limit)


def capped(follows: DataFrame, by: str, cap: int, order: Column) -> DataFrame:
    """At most cap rows for each value of ``by``; tasks cut their own rows before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return follows.withColumn("nth", nth).where(F.col("nth") <= cap).drop("nth")


def batches(users: DataFrame, size: int) -> DataFrame:
    """n_users, n_batches of lookups that take ``size`` users each."""
    return users.agg(F.count("*").alias("n_users")).select("n_users", F.ceil(F.col("n_users") / size).alias("n_batches"))


def first_hop(follows: DataFrame, core: DataFrame, profiles: DataFrame, limit: int) -> DataFrame:
    """Edges from kept followers to the core user. core: one row (core)."""
    return within_limit(follows.join(core, follows["dst"] == core["core"], "left_semi"), profiles, limit).where("keep").select("src", "dst")


def second_hop(follows: DataFrame, first: DataFrame, profiles: DataFrame, limit: int) -> DataFrame:
    """Edges from kept followers to the users of the first hop."""
    return second_hop_judged(follows, first, profiles, limit).where("keep").select("src", "dst")


def second_hop_judged(follows: DataFrame, first: DataFrame, profiles: DataFrame, limit: int) -> DataFrame:
    heads = first.select(F.col("src").alias("dst")).distinct()
    return within_limit(follows.join(heads, "dst", "left_semi").select("src", "dst"), profiles, limit)


def known_users(core: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    return core.select(F.col("core").alias("v")).union(first.select("src")).union(second.select("src")).distinct()


def cross_links(follows: DataFrame, second: DataFrame, known: DataFrame, max_follows: int | None = None) -> DataFrame:
    """Edges of second-hop users to known users other than themselves; max_follows caps what is read of each user."""
    own = follows.join(second.select("src").distinct(), "src", "left_semi").select("src", "dst")
    if max_follows is not None:
        own = capped(own, "src", max_follows, F.asc("dst"))
    return own.join(known.select(F.col("v").alias("dst")), "dst", "left_semi").where("src <> dst").select("src", "dst")


def uses_relationships(n_known: int, resolved: bool, per_call: int = 30, calls: int = 5) -> bool:
    """Whether asking for relationships takes fewer calls than reading follows."""
    return resolved and n_known / per_call <= calls


def collect_network(follows: DataFrame, core: DataFrame, profiles: DataFrame, limit: int, max_follows: int | None = None) -> DataFrame:
    """All edges, with repeats, and the pass (1, 2, 3) that found them."""
    first = first_hop(follows, core, profiles, limit)
    second = second_hop(follows, first, profiles, limit)
    cross = cross_links(follows, second, known_users(core, first, second), max_follows)
    tag = lambda df, n: df.select("src", "dst", F.lit(n).alias("hop"))
    return tag(first, 1).unionByName(tag(second, 2)).unionByName(tag(cross, 3))
