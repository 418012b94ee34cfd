import csv
import json
import os

import pytest
from pyspark.sql import functions as F

import replay
from orbweave.operators import report, spins
from orbweave.sources import files
from orbweave.sources.social import Client, SocialSource, calibrate
from orbweave.streaming.posts import without_repeats, words_by_window


@pytest.fixture(scope="module")
def social(spark):
    spark.dataSource.register(SocialSource)
    os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(__file__), os.environ.get("PYTHONPATH", "")])
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "replay.py"))

    def read(endpoint, actors, **more):
        return spark.read.format("social").options(endpoint=endpoint, actors=actors, transport="replay:transport", **more).load()

    return read


def test_source_reads_every_endpoint(social):
    got = social("followers", "u1,u2").collect()
    assert {(r["src"], r["dst"]) for r in got} == {(f, u) for u in ("u1", "u2") for f in replay.FOLLOWERS[u]} and {r["status"] for r in got} == {"ok"}
    assert social("followers", "u1", cap=3).count() == 3
    assert {(r["src"], r["dst"]) for r in social("follows", '["u1"]').collect()} == {("u1", f) for f in replay.FOLLOWERS if "u1" in replay.FOLLOWERS[f]}
    profiles = {r["handle"]: r["followers_count"] for r in social("profiles", ",".join(f"u{i}" for i in range(60)), partitions=2).collect()}
    assert len(profiles) == 59 and "u3" not in profiles and profiles["u1"] == len(replay.FOLLOWERS["u1"])
    others = json.dumps({f"did:{i}": f"u{i}" for i in range(70)})
    assert {r["dst"] for r in social("relationships", "u1", others=others).collect()} == {f"u{i}" for i in range(70) if i % 10 == 1}
    feed = social("feed", "u1,u2", cap=120).groupBy("user").count().collect()
    assert [r["count"] for r in feed] == [120, 120]


def test_failures_are_statuses():
    waits = []
    answers = iter([(429, {}), (200, {"followers": [{"handle": "a"}], "cursor": "c"}), (500, {})])
    client = Client(lambda *a: next(answers), waits.append)
    assert list(client.followers("x")) == [("a", "x", "ok"), (None, "x", "http 500")] and waits == [1]
    busy = Client(lambda *a: (429, {}), waits.append)
    assert list(busy.followers("x")) == [(None, "x", "http 429")] and waits[1:] == [1, 2, 4, 8, 16]

    def broken(*a):
        raise OSError

    assert list(Client(broken).profiles(["a", "b"])) == [("a", None, None, "error: OSError"), ("b", None, None, "error: OSError")]


def test_calibration():
    assert calibrate(lambda n: True) == 100 and calibrate(lambda n: n < 50) == 35 and calibrate(lambda n: False) == 10


def test_graph_file_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([('a "&<', 1), ("7", -1)], "id string, community_id int")
    edges = spark.createDataFrame([('a "&<', "7")], "src string, dst string")
    path = files.write_gexf(f"{tmp_path}/x/g.gexf", nodes, edges)
    assert {tuple(r) for r in files.read_gexf_nodes(spark, path).collect()} == {('a "&<', 1), ("7", -1)}
    assert [tuple(r) for r in files.read_gexf_edges(spark, path).collect()] == [('a "&<', "7")]
    bare = files.write_gexf(f"{tmp_path}/b.gexf", nodes.select("id"), edges.limit(0))
    assert {r["community_id"] for r in files.read_gexf_nodes(spark, bare).collect()} == {None}


def test_keywords_keep_words_that_look_like_nulls(spark, tmp_path):
    rows = [(w, 3, 1.5, "g") for w in ("nan", "null", "007", "na", "NaN", "a,b", 'q"q')]
    df = spark.createDataFrame(rows, files.KEYWORDS)
    assert {r["word"] for r in files.read_keywords(spark, files.write_keywords(f"{tmp_path}/k", df)).collect()} == {r[0] for r in rows}
    (tmp_path / "bom.csv").write_text("word,occurrences,desvio_padrao,source_gexf\nálgebra,3,0.5,g\n", encoding="utf-8-sig")
    assert [r["word"] for r in files.read_keywords(spark, f"{tmp_path}/bom.csv").collect()] == ["álgebra"]


def test_spins_and_vocabularies_round_trip(spark, tmp_path):
    wide = spark.createDataFrame([("u", 1, -1), ("v", -1, 5)], "user string, ab int, cd int")
    got = {(r["user"], r["word"]): r["spin"] for r in files.read_spins(spark, files.write_spins(f"{tmp_path}/s", wide), ["ab", "cd"]).collect()}
    assert got == {("u", "ab"): 1, ("u", "cd"): -1, ("v", "ab"): -1, ("v", "cd"): 1}
    users, words = ["p:1", "p:2", "p:3"], {"p:1": {"one", "é"}, "p:2": {"x"}}
    (tmp_path / "c.json").write_text(files.vocabularies_to_json(users, words))
    u, w = files.vocabularies_from_json(spark, f"{tmp_path}/c.json")
    assert {r["user"] for r in u.collect()} == set(users) and {tuple(r) for r in w.collect()} == {(k, x) for k, ws in words.items() for x in ws}


def test_reports_and_numbers(spark, tmp_path):
    import datetime

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    graphs, reports = f"{tmp_path}/g", f"{tmp_path}/r"
    path = report.write_network(reports, edges, 2, 0.25, "seed", [3, 1], datetime.datetime(2024, 1, 2, 3, 4, 5))
    report.write_network(reports, edges, 2, 0.25)
    text = open(path, encoding="utf-8").read()
    assert text.count("ANÁLISE EM:") == 2 and "ANÁLISE EM: 2024-01-02 03:04:05\n" in text and "Densidade do grafo: 0.666667\n" in text and "(índices): 1, 3\n" in text
    assert report.next_number(graphs, reports) == 1
    lines = open(report.write_community(reports, edges, 1, 9), encoding="utf-8").read().splitlines()
    assert lines[0].startswith("=== RELATÓRIO DA SUBCOMUNIDADE 1 (ID Original: 9)") and lines[-4:] == ["1. 3", "2. 1", "3. 2", "4. 4"]
    os.makedirs(graphs)
    open(f"{graphs}/comunidade_2_x.gexf", "w").close()
    assert report.next_number(graphs, reports) == 3
    assert report.find_files(graphs, ".gexf") == [f"{graphs}/comunidade_2_x.gexf"] and report.find_files(str(tmp_path), ".gexf", "comunidade", deep=True) and report.find_files("/none", "x") == []


def test_streams(spark, tmp_path):
    rows = [(1, "u", "2023-03-03 00:00:00", "alpha beta"), (1, "u", "2023-03-03 00:00:00", "alpha beta"), (2, "v", "2023-03-04 00:00:00", "alpha"), (3, "v", "2023-04-20 00:00:00", "late")]
    spark.createDataFrame(rows, "post_id long, user string, created_at string, text string").withColumn("created_at", F.col("created_at").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("post_id long, user string, created_at timestamp, text string").parquet(f"{tmp_path}/in")

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r["post_id"] for r in run(without_repeats(stream), "once", "append")) == [1, 2, 3]
    counts = {(r["word"], r["occurrences"]) for r in run(words_by_window(without_repeats(stream), late=None), "counted", "append")}
    assert {("alpha", 2), ("beta", 1)} <= counts


def test_spin_lines(spark, tmp_path):
    words = ["a,b", 'say "x"', '"', "plain", "é"]
    plus = spark.createDataFrame([('u,"1"', "a,b"), ('u,"1"', "é"), ("user", '"')], "user string, word string")
    users = spark.createDataFrame([('u,"1"',), ("user",), ("",)], "user string")
    keywords = spark.createDataFrame([(w,) for w in words], "word string")
    want = spins.dense(users, keywords, plus)
    got = files.read_spin_lines(spark, files.write_spin_lines(f"{tmp_path}/lines", keywords, spins.rows(want)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 15
    header = next(p for p in (tmp_path / "lines" / "header").iterdir() if p.suffix == ".txt").read_text()
    assert next(csv.reader([header.rstrip("\n")])) == ["user", *sorted(words)]


def test_spin_lines_make_spins_in_the_last_step(spark, tmp_path):
    users = spark.createDataFrame([(f"u{i}",) for i in range(4)], "user string")
    listed = spark.createDataFrame([("a", ["u1", "u3"]), ("b", ["u0"]), ("c", ["u2", "u3"])], "word string, users array<string>")
    got = files.read_spin_lines(spark, files.write_spin_lines(f"{tmp_path}/lines", listed, spins.states(users, listed)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, spins.dense(users, listed, listed).collect()))
    assert "hashpartitioning(pos" not in got._jdf.queryExecution().executedPlan().toString()
    spark.createDataFrame([("u9,1,-1",)], "value string").write.mode("append").text(f"{tmp_path}/lines/rows")
    with pytest.raises(Exception, match="2 fields and the header 3"):
        files.read_spin_lines(spark, f"{tmp_path}/lines").collect()


def test_spin_lines_from_texts_and_of_other_numbers(spark, tmp_path):
    users = spark.createDataFrame([(f"u{i}",) for i in range(4)], "user string")
    listed = spark.createDataFrame([("a", ["u1", "u3"]), ("b", ["u0"]), ("c", ["u2", "u3"])], "word string, users array<string>")
    folder = files.write_spin_lines(f"{tmp_path}/lines", listed, spins.state_lines(users, listed))
    want = sorted(map(tuple, spins.dense(users, listed, listed).collect()))
    assert sorted(map(tuple, files.read_spin_lines(spark, folder).collect())) == want
    spark.createDataFrame([("u8,0,-3,5",), ("u9,-1,11,1",)], "value string").write.mode("append").text(f"{folder}/rows")
    more = [("u8", "a", -1), ("u8", "b", -1), ("u8", "c", 1), ("u9", "a", -1), ("u9", "b", 1), ("u9", "c", 1)]
    assert sorted(map(tuple, files.read_spin_lines(spark, folder).collect())) == sorted(want + more)
