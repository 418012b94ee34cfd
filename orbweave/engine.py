"""The three analyses from end to end, without prompts: every choice is an argument.

    s = Session(spark, folder="out")
    edges = s.collect(follows, profiles, "seed", max_followers=5000)
    graph = s.graph(edges); found = s.communities(graph); s.export(graph, found, resolution=1.0, cids=[0, 1], core="seed")
    words, stats = s.posts(posts); keywords = s.keywords(stats, 0.0, 100.0, 5, source="comunidade_1")
    users, listed, plus = s.spins(words, keywords); s.ising(users, listed, plus)
"""

from __future__ import annotations

import os
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.materialize import materialize
from .operators import community, graph, ising, network, report, spins, words
from .sources import files

#: Followers above which a user is left out, unless told otherwise.
MAX_FOLLOWERS = 5000


class Session:
    def __init__(self, spark: SparkSession, folder: str = "data", session_id: str | None = None):
        self.spark, self.folder = spark, folder
        self.session_id = session_id or datetime.now().strftime("%Y%m%d_%H%M%S")

    def path(self, *parts: str) -> str:
        return os.path.join(self.folder, f"sessao_{self.session_id}", *parts)

    # The network.

    def collect(self, follows: DataFrame, profiles: DataFrame, core, max_followers: object = MAX_FOLLOWERS, max_follows: int | None = None) -> DataFrame:
        """Edges (src, dst, hop) around the core user. A limit that is no number counts as the default."""
        try:
            limit = int(max_followers)
        except (TypeError, ValueError):
            limit = MAX_FOLLOWERS
        seed = self.spark.range(1).select(F.lit(core).alias("core"))
        return materialize(network.collect_network(follows, seed, profiles, limit, max_follows))

    def graph(self, edges: DataFrame, k: int = 2) -> DataFrame:
        """The k-core of the undirected graph without loops."""
        return graph.k_core(graph.undirected(edges), k)

    def communities(self, edges: DataFrame, resolutions: tuple[float, ...] = community.RESOLUTIONS, seed: int = 0) -> DataFrame:
        """resolution, node, cid: communities cut down to their own 2-core and numbered by size."""
        found = materialize(community.detect(edges, resolutions, seed))
        out = None
        for r in resolutions:
            part = community.renumber(community.local_core(edges, found.where(F.col("resolution") == float(r)).select("node", "cid")))
            part = part.select(F.lit(float(r)).alias("resolution"), "node", "cid")
            out = part if out is None else out.unionByName(part)
        return materialize(out)

    def summary(self, edges: DataFrame, resolutions: tuple[float, ...] = community.RESOLUTIONS, seed: int = 0) -> DataFrame:
        return community.summaries(edges, materialize(community.detect(edges, resolutions, seed)))

    def export(self, edges: DataFrame, found: DataFrame, resolution: float, cids: list[int], core: str = "N/A") -> list[dict]:
        """Graph files and reports of chosen communities and of the network; one row (cid, file, status) for each id, unknown ids included."""
        part = materialize(found.where(F.col("resolution") == float(resolution)).select("node", "cid"))
        out, shown = [], report.next_number(self.path("processed"), self.path("reports"))
        known = {r["cid"] for r in community.sizes(part).collect()}  # one row a community
        for cid in cids:
            if cid not in known:
                out.append({"cid": cid, "file": None, "status": "unknown community"})
                continue
            nodes = community.members(part, cid)
            inner = graph.induced(edges, nodes)
            file = files.write_gexf(self.path("processed", report.GRAPH_FILE.format(shown, core)), nodes.withColumn("community_id", F.lit(cid)), inner)
            report.write_community(self.path("reports"), inner, shown, cid)
            out.append({"cid": cid, "file": file, "status": "ok"})
            shown = report.next_number(self.path("processed"), self.path("reports"))
        files.write_gexf(self.path("processed", f"rede_{self.session_id}.gexf"), graph.apply_partition(graph.nodes_of(edges), part), edges)
        score = community.refined_modularity(edges, part).head()["modularity"] or 0.0
        report.write_network(self.path("reports"), edges, len(known), score, core, [r["cid"] for r in out if r["file"]])
        return out

    # Words.

    def posts(self, posts: DataFrame, cap: int = 3000) -> tuple[DataFrame, DataFrame]:
        """Words (post_id, user, word, age) of each user's newest posts, and their statistics."""
        found = materialize(words.post_words(words.newest_posts(words.with_time(posts), cap)))
        return found, words.interval_spread(found)

    def keywords(self, stats: DataFrame, least: float = 0.0, most: float = 10_000.0, occurrences: int = 1, source: str = "") -> DataFrame:
        """The chosen words, least spread first, also written as CSV."""
        chosen = words.with_source(words.filter_keywords(stats, least, most, occurrences), source).orderBy("desvio_padrao", "word")
        files.write_keywords(self.path("keywords_filtradas"), chosen)
        return chosen

    def vocabularies(self, name: str, users: DataFrame | None = None, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Users and their words kept under a name: written if given, else read back."""
        folder = self.path(f".cache_usersets_{name}")
        if users is not None:
            files.write_vocabularies(folder, users, words.user_words(found))
        return files.read_vocabularies(self.spark, folder)

    # Models.

    def spins(self, found: DataFrame, keywords: DataFrame, users: DataFrame | None = None, most: int = 5000) -> tuple[DataFrame, list[str], DataFrame]:
        """Users, the list of keywords (a pivot's columns: more than ``most`` are refused) and the +1 spins."""
        clean = spins.clean_keywords(keywords.select(F.monotonically_increasing_id().alias("pos"), "word"))
        listed = [r["word"] for r in clean.orderBy("pos").limit(most + 1).collect()]
        if not listed or len(listed) > most:
            raise ValueError(f"between 1 and {most} keywords are needed")
        users = users if users is not None else found.select("user").distinct()
        return users, listed, spins.active(found, clean)

    def ising(self, users: DataFrame, listed: list[str], plus: DataFrame, grid: list[tuple] = ising.GRID, lam: float = 0.01, seed: int = 0) -> DataFrame:
        """The comparison table of the fits; parameters of the chosen one go to a file. lam is accepted and has no effect."""
        fits = materialize(ising.compare_fits(spins.dense(users, listed, plus), grid, seed))
        n = users.count()
        table = materialize(ising.comparison_table(fits, n, len(listed)))
        best = ising.select_model(fits, 3.0 / len(listed) ** 0.5).head()
        if best is not None:
            save_multipliers(self.path("multiplicadores_MCH.npy"), best["parameters"])
        table.write.mode("overwrite").option("header", True).csv(self.path("comparacao_metodos"))
        return table

    def figure(self, users: DataFrame, listed: list[str], plus: DataFrame, edges: DataFrame) -> DataFrame:
        """Covariances masked by the graph (unmasked, if under half of the users are in it)."""
        cov = spins.covariance(users, plus, len(listed))
        if not spins.mask_enabled(users, edges).head()["enabled"]:
            return cov
        return spins.masked(cov, spins.adjacency(users, edges), "cov")


def save_multipliers(path: str, parameters: list[float] | None) -> str | None:
    """The flat parameters of a fit that succeeded."""
    if parameters is None:
        return None
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    np.save(path, np.asarray(parameters, float))
    return path
