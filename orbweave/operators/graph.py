"""Undirected simple graphs held as edge tables (src < dst) and node tables (id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.materialize import materialize


def undirected(edges: DataFrame) -> DataFrame:
    """Each unordered pair once; loops stay."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree. A loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (id)."""
    kept = nodes.select("id").distinct()
    return edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def k_core(edges: DataFrame, k: int = 2, max_rounds: int = 10_000) -> DataFrame:
    """Edges of the largest subgraph in which every degree is at least k.

    Rounds of peeling; the edges are written to the shared folder each round, so plans stay short and a lost executor costs a round. The
    driver sees one count a round.
    """
    now = materialize(without_loops(edges).select("src", "dst"))
    n = now.count()
    for _ in range(max_rounds):
        step = materialize(induced(now, degrees(now).where(F.col("degree") >= k)))
        left = step.count()
        now = step
        if left in (0, n):
            return now
        n = left
    raise RuntimeError(f"peeling did not settle in {max_rounds} rounds")


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """num_nodes, num_edges, density, avg_degree; 0 where there are no nodes (or no pairs)."""
    n, m = F.col("num_nodes"), F.col("num_edges")
    both = nodes.select(F.lit(1).alias("v"), F.lit(0).alias("e")).unionAll(edges.select(F.lit(0), F.lit(1))).agg(F.coalesce(F.sum("v"), F.lit(0)).alias("num_nodes"), F.coalesce(F.sum("e"), F.lit(0)).alias("num_edges"))
    return both.select("num_nodes", "num_edges", F.when(n > 1, 2.0 * m / (n * (n - 1))).otherwise(0.0).alias("density"), F.when(n > 0, 2.0 * m / n).otherwise(0.0).alias("avg_degree"))


def top_by_degree(edges: DataFrame, n: int = 5) -> DataFrame:
    """The n nodes of the largest degree; ties go to the smaller id."""
    return degrees(edges).orderBy(F.desc("degree"), F.asc("id")).limit(n)


def hubs(edges: DataFrame, most: int = 1000) -> DataFrame:
    """The part of a graph that is drawn: all of it below ``most`` nodes, else what its ``most`` best linked nodes induce."""
    return induced(edges, top_by_degree(edges, most))


def drawing_style(n: int) -> dict[str, float]:
    """Sizes and opacity of a drawing of n nodes."""
    return {"fig_size": float(max(6, min(10, n / 5))), "node_size": float(max(20, min(120, 2000 // n))) if n else 120.0, "edge_alpha": 0.5 if n < 200 else 0.3}


def apply_partition(nodes: DataFrame, partition: DataFrame) -> DataFrame:
    """id, community_id of every node; -1 where the partition (node, cid) doesn't name it."""
    return nodes.join(partition.select(F.col("node").alias("id"), F.col("cid").alias("community_id")), "id", "left").select("id", F.coalesce("community_id", F.lit(-1)).cast("int").alias("community_id"))


def layout(edges: list[tuple[int, int]], n: int, k: float = 0.15, iterations: int = 200, seed: int = 42):
    """Force-directed positions (Fruchterman-Reingold) of nodes 0..n-1, scaled to [-1, 1]. For graphs of at most a drawing's size."""
    import numpy as np

    rng = np.random.default_rng(seed)
    at = rng.random((n, 2))
    if n < 2:
        return at * 0
    pull = np.zeros((n, n))
    for a, b in edges:
        pull[a, b] = pull[b, a] = 1
    heat = max(np.ptp(at[:, 0]), np.ptp(at[:, 1])) * 0.1
    cool = heat / (iterations + 1)
    for _ in range(iterations):
        gap = at[:, None] - at[None]
        far = np.maximum(np.sqrt((gap**2).sum(-1)), 0.01)
        move = (gap * (k * k / far**2 - pull * far / k)[..., None]).sum(1)
        size = np.maximum(np.sqrt((move**2).sum(1)), 0.01)
        at += move * (heat / size)[:, None]
        heat -= cool
    at -= at.mean(0)
    return at / np.abs(at).max()
