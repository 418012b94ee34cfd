"""python -m orbweave SPINS.csv GRAPH.gexf [--lam X] [--validar]: fits a model to a table of spins."""

from __future__ import annotations

import argparse
import csv

from pyspark.sql import functions as F

from .engine import Session
from .operators import ising
from .session import local_session
from .sources import files


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="orbweave", description="Fits a pairwise maximum-entropy model to a table of spins.")
    parser.add_argument("csv_path", help="first column: user; one column for each keyword")
    parser.add_argument("gexf_path", help="graph whose links mask the covariances")
    parser.add_argument("--lam", type=float, default=0.01, help="accepted, without effect")
    parser.add_argument("--validar", action="store_true", help="also sample the chosen model")
    given = parser.parse_args(args)
    spark = local_session()
    with open(given.csv_path, encoding="utf-8-sig", newline="") as file:
        listed = next(csv.reader(file))[1:]
    long = files.read_spins(spark, given.csv_path, listed)
    users, plus = long.select("user").distinct(), long.where("spin = 1").select("user", "word")
    session = Session(spark)
    session.ising(users, listed, plus, lam=given.lam).show(truncate=False)
    edges = files.read_gexf_edges(spark, given.gexf_path)
    session.figure(users, listed, plus, edges).where(F.col("cov").isNotNull()).show(20)
    if given.validar:
        import numpy as np

        parameters = np.load(session.path("multiplicadores_MCH.npy")).tolist()
        ising.validate(spark, parameters, users.count()).agg(F.avg(F.abs("cov")).alias("mean_abs_cov")).show()


if __name__ == "__main__":
    main()
