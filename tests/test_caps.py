"""The limits of the sources, as features: small caps on small tables."""

from pyspark.sql import functions as F

from orbweave.operators import graph, network, words


def test_caps_keep_the_first_of_each(spark):
    links = spark.createDataFrame([(i, j) for i in range(6) for j in range(i + 1)], "src int, dst int")
    got = {(r["src"], r["dst"]) for r in network.capped(links, "src", 3, F.asc("dst")).collect()}
    assert got == {(i, j) for i in range(6) for j in range(i + 1) if j < 3}
    got = {(r["src"], r["dst"]) for r in network.capped(links, "dst", 2, F.asc("src")).collect()}
    assert got == {(i, j) for j in range(6) for i in range(j, 6) if i < j + 2}


def test_newest_posts_of_each_user(spark):
    posts = spark.createDataFrame([(i, i % 2, f"2024-01-{1 + i // 4:02d}") for i in range(20)], "post_id int, user int, day string").withColumn("created_at", F.to_timestamp("day"))
    assert sorted(r["post_id"] for r in words.newest_posts(posts, 3).collect()) == [14, 15, 16, 17, 18, 19]


def test_hubs_are_the_highest_degrees(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 6)] + [(1, 2), (1, 3), (4, 5)], "src long, dst long")
    assert {(r["src"], r["dst"]) for r in graph.hubs(edges, 3).collect()} == {(0, 1), (0, 2), (1, 2)}
