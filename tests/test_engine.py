import datetime
import os
import random

import numpy as np

from orbweave.engine import Session, save_multipliers
from orbweave.sources import files


def test_from_seed_to_reports(spark, tmp_path):
    rng = random.Random(1)
    follows = [(f"u{a}", f"u{b}") for a in range(30) for b in range(30) if a != b and (a // 15 == b // 15 and rng.random() < 0.5 or rng.random() < 0.02)]
    s = Session(spark, str(tmp_path), "test")
    edges = s.collect(spark.createDataFrame(follows, "src string, dst string"), spark.createDataFrame([("u1", 9)], "handle string, followers_count long"), "u0", "many")
    core = s.graph(edges)
    found = s.communities(core, (1.0,))
    assert found.count() > 10 and s.summary(core, (1.0,)).count() == 1
    rows = s.export(core, found, 1.0, [0, 99], "u0")
    assert [r["status"] for r in rows] == ["ok", "unknown community"]
    assert files.read_gexf_nodes(spark, rows[0]["file"]).count() == found.where("cid = 0").count()
    assert sorted(os.listdir(s.path("reports"))) == ["relatorio_comunidade_1.txt", "relatorio_geral_rede.txt"]
    assert s.export(core, found, 1.0, [0], "u0")[0]["file"].endswith("comunidade_2_u0.gexf")


def test_from_posts_to_a_model(spark, tmp_path):
    rng = random.Random(2)
    start = datetime.datetime(2023, 3, 1)
    posts = [(i, f"u{i % 5}", (start + datetime.timedelta(hours=rng.randrange(900))).strftime("%Y-%m-%dT%H:%M:%S.123456789Z"), " ".join(rng.sample([f"word{k}" for k in range(12)], 3))) for i in range(60)]
    s = Session(spark, str(tmp_path), "test")
    found, stats = s.posts(spark.createDataFrame(posts, "post_id long, user string, created_at string, text string"))
    keywords = s.keywords(stats, 0.0, 1000.0, 3, "g")
    assert keywords.count() == 12 and files.read_keywords(spark, s.path("keywords_filtradas")).count() == 12
    users, kept = s.vocabularies("g", found.select("user").distinct(), found)
    assert users.count() == 5 and s.vocabularies("g")[1].count() == kept.count()
    who, listed, plus = s.spins(found, keywords)
    table = s.ising(who, listed, plus, [(5, 0.05, 10, 20)])
    row = table.head()
    assert (row["N"], row["R"]) == (5, 12) and row["viavel"] == (row["rmse_medias"] <= row["limiar_schneidman"])
    assert np.load(s.path("multiplicadores_MCH.npy")).shape == (15,) and save_multipliers("x", None) is None
    edges = spark.createDataFrame([("u0", "u1"), ("u1", "u2")], "src string, dst string")
    figure = s.figure(who, listed, plus, edges)
    assert figure.count() == 15 and figure.where("cov IS NOT NULL").count() == 7
    assert s.figure(who, listed, plus, edges.limit(0)).where("cov IS NULL").count() == 0
