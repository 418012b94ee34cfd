import random

import numpy as np
import pytest

from orbweave.operators import community, graph, network


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def brute_core(pairs, k):
    e = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    while True:
        degree = {}
        for a, b in e:
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        left = {(a, b) for a, b in e if degree[a] >= k and degree[b] >= k}
        if left == e:
            return e
        e = left


@pytest.mark.parametrize("k", [2, 3])
def test_core_against_brute_force(spark, k):
    rng = random.Random(k)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (5, 5)]
    got = {tuple(r) for r in graph.k_core(graph.undirected(edges(spark, pairs)), k).collect()}
    assert got == brute_core(pairs, k)
    again = {tuple(r) for r in graph.k_core(edges(spark, list(got)) if got else edges(spark, []), k).collect()}
    assert again == got


def test_trees_and_nothing_have_no_core(spark):
    assert graph.k_core(edges(spark, [(1, 2), (2, 3), (2, 4)])).collect() == []
    assert graph.k_core(edges(spark, [])).collect() == []
    assert tuple(graph.metrics(graph.nodes_of(edges(spark, [])), edges(spark, [])).head()) == (0, 0, 0.0, 0.0)


def test_filters_of_both_hops(spark):
    follows = edges(spark, [(2, 1), (3, 1), (4, 2), (5, 2), (5, 1), (4, 3), (2, 4), (4, 4)])
    profiles = spark.createDataFrame([(3, 99), (5, 40), (4, 3)], "handle long, followers_count long")
    core = spark.createDataFrame([(1,)], "core long")
    for limit, want in ((40, {(2, 1), (5, 1)}), (39, {(2, 1)}), (0, {(2, 1), (3, 1), (5, 1)}), (-1, {(2, 1), (3, 1), (5, 1)})):
        first = network.first_hop(follows, core, profiles, limit)
        assert {tuple(r) for r in first.collect()} == want
    found = {tuple(r) for r in network.collect_network(follows, core, profiles, 40).collect()}
    assert found == {(2, 1, 1), (5, 1, 1), (4, 2, 2), (5, 2, 2), (5, 1, 3), (5, 2, 3), (4, 2, 3)}
    assert network.uses_relationships(150, True) and not network.uses_relationships(151, True) and not network.uses_relationships(9, False)


def two_cliques():
    return [(a, b) for o in (0, 10) for a in range(o, o + 6) for b in range(a + 1, o + 6)] + [(0, 10)]


def objective(pairs, label, gamma):
    m = len(pairs)
    inner = sum(label[a] == label[b] for a, b in pairs)
    k = {}
    for a, b in pairs:
        for v in (a, b):
            k[label[v]] = k.get(label[v], 0) + 1
    return inner / m - gamma * sum((x / (2 * m)) ** 2 for x in k.values())


def test_leiden_finds_planted_communities_and_repeats(spark):
    found = {}
    for r in community.detect(edges(spark, two_cliques()), (1.0, 2.0)).collect():
        found.setdefault(r["resolution"], {})[r["node"]] = r["cid"]
    assert len(set(found[1.0].values())) == 2 and len({found[1.0][v] for v in range(6)}) == 1 and found[1.0][0] != found[1.0][10]
    rng = random.Random(0)
    pairs = sorted({tuple(sorted(rng.sample(range(80), 2))) for _ in range(240)})
    for gamma in (0.5, 1.0, 2.0):
        a, b = (community.leiden_labels(pairs, 80, gamma, seed=4) for _ in range(2))
        assert (a == b).all() and objective(pairs, a, gamma) >= objective(pairs, np.arange(80), gamma)
        neighbours = [{} for _ in range(80)]
        for x, y in pairs:
            neighbours[x][y] = neighbours[y][x] = 1.0
        assert len(np.unique(community._connected(neighbours, a))) == len(np.unique(a))
        greedy = max(objective(pairs, np.arange(80) // s, gamma) for s in (1, 5, 20, 80))
        assert objective(pairs, a, gamma) >= greedy - 1e-9


def test_refinement_and_numbering(spark):
    pairs = two_cliques() + [(20, 21), (5, 20)]
    part = spark.createDataFrame([(v, 7 if v < 10 else 3 if v < 20 else 9) for v in {x for p in pairs for x in p}], "node long, cid int")
    e = edges(spark, pairs)
    core = community.local_core(e, part)
    assert {r["node"] for r in core.collect()} == set(range(6)) | set(range(10, 16))
    row = community.summary(e, part, core).head()
    assert row["num_communities"] == 2 and row["max_size"] == row["min_size"] == 6 and row["modularity"] > 0.4
    assert {r["cid"] for r in community.renumber(part).where("node < 10").collect()} == {0}
    none = community.summary(e, part, core.limit(0)).head()
    assert (none["num_communities"], none["modularity"], none["max_size"]) == (0, 0.0, 0)
    assert {tuple(r) for r in graph.apply_partition(graph.nodes_of(e), part.where("cid = 7")).where("community_id = -1").select("id").collect()} == {(v,) for v in (10, 11, 12, 13, 14, 15, 20, 21)}


def test_summaries_of_all_resolutions_equal_single_ones(spark):
    e = edges(spark, two_cliques())
    found = community.detect(e, (0.5, 1.0, 4.0))
    got = {r["resolution"]: r for r in community.summaries(e, found).collect()}
    for gamma, r in got.items():
        part = found.where(f"resolution = {gamma}").select("node", "cid")
        one = community.summary(e, part, community.local_core(e, part)).head()
        assert all(abs(r[c] - one[c]) < 1e-12 for c in one.asDict()), (gamma, r, one)
    assert set(got) == {0.5, 1.0, 4.0}


def test_layout_and_style():
    at = graph.layout([(0, 1), (1, 2)], 3)
    assert at.shape == (3, 2) and abs(at).max() == 1.0 and (at == graph.layout([(0, 1), (1, 2)], 3)).all()
    assert graph.drawing_style(10) == {"fig_size": 6.0, "node_size": 120.0, "edge_alpha": 0.5} and graph.drawing_style(300)["edge_alpha"] == 0.3
