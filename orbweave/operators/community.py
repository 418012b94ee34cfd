"""Communities: detection at several resolutions, modularity, refinement by a local 2-core, numbering and summaries.

edges: src, dst (undirected, simple). partition: node, cid.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import degrees, induced, k_core, nodes_of

RESOLUTIONS = (1.0, 1.5, 2.0, 2.5, 3.0)


def members(partition: DataFrame, cid: int) -> DataFrame:
    """Nodes (id) of one community; -1 names none."""
    return partition.where((F.col("cid") == cid) & (F.col("cid") != -1)).select(F.col("node").alias("id"))


def inner_edges(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """src, dst, cid of the edges within a community."""
    a = partition.select(F.col("node").alias("src"), F.col("cid"))
    b = partition.select(F.col("node").alias("dst"), F.col("cid").alias("cid_b"))
    return edges.join(a, "src").join(b, "dst").where("cid = cid_b").select("src", "dst", "cid")


def modularity(edges: DataFrame, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity): the sum over communities of L/m - resolution * (K / 2m)**2; null without edges."""
    total = edges.agg(F.count("*").alias("m"))
    k = degrees(edges).join(partition.withColumnRenamed("node", "id"), "id").groupBy("cid").agg(F.sum("degree").alias("k"))
    inside = inner_edges(edges, partition).groupBy("cid").agg(F.count("*").alias("l"))
    # total has one row; its broadcast is of a fixed size.
    rows = k.join(inside, "cid", "left").join(F.broadcast(total))
    return rows.agg(F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - resolution * F.pow(F.col("k") / (2.0 * F.col("m")), F.lit(2.0))).alias("modularity"))


def local_core(edges: DataFrame, partition: DataFrame, k: int = 2) -> DataFrame:
    """node, cid of those left when each community is cut down to its own k-core.

    Edges between communities go first; then one peeling serves all communities, as no path joins two of them.
    """
    core = k_core(inner_edges(edges, partition).select("src", "dst"), k)
    return partition.join(nodes_of(core).withColumnRenamed("id", "node"), "node", "left_semi")


def refined_modularity(edges: DataFrame, survivors: DataFrame) -> DataFrame:
    """Modularity of the survivors on the graph that they induce (edges between communities included)."""
    return modularity(induced(edges, survivors.select(F.col("node").alias("id"))), survivors)


def renumber(partition: DataFrame) -> DataFrame:
    """node, cid numbered from 0 by size (largest first), then smallest node. The numbering runs over communities, not nodes."""
    sizes = partition.groupBy("cid").agg(F.count("*").alias("size"), F.min("node").alias("first"))
    numbered = sizes.withColumn("new", F.row_number().over(Window.orderBy(F.desc("size"), F.asc("first"))) - 1)
    return partition.join(numbered.select("cid", "new"), "cid").select("node", F.col("new").alias("cid"))


def sizes(partition: DataFrame) -> DataFrame:
    return partition.groupBy("cid").agg(F.count("*").alias("size"))


def summary(edges: DataFrame, initial: DataFrame, refined: DataFrame) -> DataFrame:
    """num_communities, initial_mod, modularity, max_size, min_size; 0 where nothing is left."""
    of = sizes(refined).agg(F.count("*").alias("num_communities"), F.coalesce(F.max("size"), F.lit(0)).alias("max_size"), F.coalesce(F.min("size"), F.lit(0)).alias("min_size"))
    before = modularity(edges, initial).withColumnRenamed("modularity", "initial_mod")
    after = refined_modularity(edges, refined).select(F.coalesce("modularity", F.lit(0.0)).alias("modularity"))
    return F.broadcast(of).join(F.broadcast(before)).join(F.broadcast(after)).select("num_communities", "initial_mod", "modularity", "max_size", "min_size")  # one row each


def summaries(edges: DataFrame, found: DataFrame) -> DataFrame:
    """resolution and the figures of summary() for every resolution of found (resolution, node, cid), refined together.

    Communities of all resolutions become communities of one disjoint graph, (resolution, node) being its nodes, so one peeling serves them all.
    """
    key = lambda node: F.struct("resolution", F.col(node).alias("v"))
    every = edges.join(F.broadcast(found.select("resolution").distinct()))  # as many rows as resolutions
    wide = every.select("resolution", key("src").alias("src"), key("dst").alias("dst"))
    part = found.select(key("node").alias("node"), F.struct("resolution", "cid").alias("cid"))
    core = local_core(wide.select("src", "dst"), part)
    inner = induced(wide.select("src", "dst"), core.select(F.col("node").alias("id")))

    def scores(of: DataFrame, groups: DataFrame, name: str) -> DataFrame:
        total = of.groupBy(F.col("src.resolution").alias("resolution")).agg(F.count("*").alias("m"))
        k = degrees(of).join(groups.withColumnRenamed("node", "id"), "id").groupBy("cid").agg(F.sum("degree").alias("k"))
        inside = inner_edges(of, groups).groupBy("cid").agg(F.count("*").alias("l"))
        rows = k.join(inside, "cid", "left").withColumn("resolution", F.col("cid.resolution")).join(total, "resolution")
        return rows.groupBy("resolution").agg(F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("k") / (2.0 * F.col("m")), F.lit(2.0))).alias(name))

    size = sizes(core).groupBy(F.col("cid.resolution").alias("resolution")).agg(F.count("*").alias("num_communities"), F.max("size").alias("max_size"), F.min("size").alias("min_size"))
    out = scores(wide.select("src", "dst"), part, "initial_mod").join(size, "resolution", "left").join(scores(inner, core, "modularity"), "resolution", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("resolution", zero("num_communities"), "initial_mod", F.coalesce("modularity", F.lit(0.0)).alias("modularity"), zero("max_size"), zero("min_size"))


def _moves(neighbours: list[dict], weight: np.ndarray, label: np.ndarray, gamma: float, m2: float, rng, within: np.ndarray | None = None) -> bool:
    """Local moving: nodes go, in random order, to the community that raises the objective most. within: only to neighbours of the same outer community."""
    total = np.bincount(label, weights=weight, minlength=len(label)).astype(float)
    waiting, moved = list(rng.permutation(len(label))), False
    queued = np.ones(len(label), bool)
    while waiting:
        v = waiting.pop()
        queued[v] = False
        links: dict[int, float] = {}
        for u, w in neighbours[v].items():
            if u != v and (within is None or within[u] == within[v]):
                links[label[u]] = links.get(label[u], 0.0) + w
        own = label[v]
        total[own] -= weight[v]
        best, gain = own, links.get(own, 0.0) - gamma * weight[v] * total[own] / m2
        for c in sorted(links):
            g = links[c] - gamma * weight[v] * total[c] / m2
            if g > gain + 1e-12:
                best, gain = c, g
        total[best] += weight[v]
        if best != own:
            label[v], moved = best, True
            for u in neighbours[v]:
                if label[u] != best and not queued[u]:
                    queued[u] = True
                    waiting.insert(0, u)
    return moved


def leiden_labels(edges: list[tuple[int, int]], n: int, gamma: float, seed: int = 0) -> np.ndarray:
    """Communities of nodes 0..n-1: moving, refinement that keeps communities connected, and aggregation, until nothing moves."""
    rng = np.random.default_rng(seed)
    neighbours: list[dict] = [{} for _ in range(n)]
    for a, b in edges:
        neighbours[a][b] = neighbours[b][a] = 1.0
    weight, m2 = np.array([float(len(x)) for x in neighbours]), 2.0 * max(1, len(edges))
    owner, label = np.arange(n), np.arange(n)
    for _ in range(50):
        moved = _moves(neighbours, weight, label, gamma, m2, rng)
        refined = np.arange(len(label))
        _moves(neighbours, weight, refined, gamma, m2, rng, within=label)
        refined = _connected(neighbours, refined)
        names, refined = np.unique(refined, return_inverse=True)
        if len(names) == len(label):
            if not moved:
                break
            names, refined = np.unique(_connected(neighbours, label), return_inverse=True)
            if len(names) == len(label):
                break
        merged: list[dict] = [{} for _ in names]
        for v, links in enumerate(neighbours):
            for u, w in links.items():
                a, b = refined[v], refined[u]
                if u != v or w:
                    merged[a][b] = merged[a].get(b, 0.0) + w
        outer = np.zeros(len(names), int)
        outer[refined] = label
        weight = np.bincount(refined, weights=weight)
        owner, neighbours = refined[owner], merged
        label = np.unique(outer, return_inverse=True)[1]
    return _split_original(edges, n, label[owner])


def _connected(neighbours: list[dict], label: np.ndarray) -> np.ndarray:
    """Labels of the connected parts of each community."""
    out = np.full(len(label), -1)
    for v in range(len(label)):
        if out[v] < 0:
            out[v], stack = v, [v]
            while stack:
                x = stack.pop()
                for u in neighbours[x]:
                    if out[u] < 0 and label[u] == label[v]:
                        out[u] = v
                        stack.append(u)
    return out


def _split_original(edges: list[tuple[int, int]], n: int, label: np.ndarray) -> np.ndarray:
    neighbours: list[dict] = [{} for _ in range(n)]
    for a, b in edges:
        neighbours[a][b] = neighbours[b][a] = 1.0
    return np.unique(_connected(neighbours, label), return_inverse=True)[1]


def detect(edges: DataFrame, resolutions: tuple[float, ...] = RESOLUTIONS, seed: int = 0) -> DataFrame:
    """resolution, node, cid: Leiden communities of the graph at each resolution, one task each.

    The whole graph must fit one worker (it is repeated for each resolution, not collected to the driver). A seed makes the result repeatable.
    """
    id_type = edges.schema["src"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gamma = float(pdf["resolution"].iloc[0])
        names, codes = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]), return_inverse=True)
        pairs = sorted({(min(a, b), max(a, b)) for a, b in zip(*codes.reshape(2, -1).tolist(), strict=True) if a != b})
        return pd.DataFrame({"resolution": gamma, "node": names, "cid": leiden_labels(pairs, len(names), gamma, seed).astype("int64")})

    each = edges.withColumn("resolution", F.explode(F.array(*[F.lit(float(r)) for r in resolutions])))
    return each.groupBy("resolution").applyInPandas(run, f"resolution double, node {id_type}, cid long")
