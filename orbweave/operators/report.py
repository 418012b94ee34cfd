"""Text reports of a network and of its communities, free file numbers, and the list of files of a kind."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import metrics, nodes_of, top_by_degree

# File names and the lines of both reports.
NETWORK_FILE, COMMUNITY_FILE, GRAPH_FILE = "relatorio_geral_rede.txt", "relatorio_comunidade_{}.txt", "comunidade_{}_{}.gexf"
NETWORK_LINES = ["", "=" * 50, "ANÁLISE EM: {when}", "USUÁRIO SEMENTE: {core}", "-" * 50, "Quantidade total de nós: {num_nodes}", "Quantidade total de arestas: {num_edges}", "Densidade do grafo: {density:.6f}", "Grau médio dos nós: {avg_degree:.2f}", "Número total de comunidades detectadas: {communities}", "Score final de modularidade (Leiden): {modularity:.4f}"]
EXPORTED_LINE = "Subcomunidades exportadas (índices): {}"
COMMUNITY_LINES = ["=== RELATÓRIO DA SUBCOMUNIDADE {shown} (ID Original: {cid}) ===", "Quantidade de nós internos: {num_nodes}", "Quantidade de arestas internas: {num_edges}", "Densidade da subcomunidade: {density:.6f}", "Grau médio interno: {avg_degree:.2f}", "", "Top 5 nós com maior grau (influentes):"]


def network_row(edges: DataFrame, communities: int, modularity: float, core: str = "N/A") -> DataFrame:
    """The figures of the network report as one row."""
    return metrics(nodes_of(edges), edges).select("*", F.lit(communities).alias("communities"), F.lit(float(modularity)).alias("modularity"), F.lit(core).alias("core"))


def network_text(row: dict, when: datetime, exported: list[int] | None = None) -> str:
    lines = [x.format(when=when.strftime("%Y-%m-%d %H:%M:%S"), **row) for x in NETWORK_LINES]
    if exported:
        lines.append(EXPORTED_LINE.format(", ".join(map(str, sorted(exported)))))
    return "\n".join(lines) + "\n"


def write_network(folder: str, edges: DataFrame, communities: int, modularity: float, core: str = "N/A", exported: list[int] | None = None, when: datetime | None = None) -> str:
    """Appends to the report of all networks; gives its path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, NETWORK_FILE)
    row = network_row(edges, communities, modularity, core).head().asDict()
    with open(path, "a", encoding="utf-8") as file:
        file.write(network_text(row, when or datetime.now(), exported))
    return path


def write_community(folder: str, edges: DataFrame, shown: int, cid: int) -> str:
    """Writes one community's report; gives its path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, COMMUNITY_FILE.format(shown))
    row = metrics(nodes_of(edges), edges).head().asDict()
    lines = [x.format(shown=shown, cid=cid, **row) for x in COMMUNITY_LINES]
    lines += [f"{i}. {r['id']}" for i, r in enumerate(top_by_degree(edges, 5).collect(), 1)]  # five rows
    with open(path, "w", encoding="utf-8") as file:
        file.write("\n".join(lines) + "\n")
    return path


def next_number(graph_folder: str, report_folder: str) -> int:
    """The first number from 1 that neither a community's graph nor its report uses."""
    taken = set(os.listdir(report_folder)) if os.path.isdir(report_folder) else set()
    graphs = {f.split("_")[1] for f in (os.listdir(graph_folder) if os.path.isdir(graph_folder) else []) if f.startswith("comunidade_") and f.endswith(".gexf")}
    n = 1
    while COMMUNITY_FILE.format(n) in taken or str(n) in graphs:
        n += 1
    return n


def find_files(folder: str, ending: str, having: str = "", deep: bool = False) -> list[str]:
    """Files of a folder (and those below it) by the end of their name and a part of it, sorted."""
    if not os.path.isdir(folder):
        return []
    walk = os.walk(folder) if deep else [(folder, [], os.listdir(folder))]
    return sorted(os.path.join(d, f) for d, _, files in walk for f in files if f.endswith(ending) and having in f)
