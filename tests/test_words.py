import datetime
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.functions.text import age_days, distinct_words, parse_timestamp
from orbweave.operators import words

UTC = datetime.timezone.utc


def test_times(spark):
    texts = ["2023-02-18T00:00:00Z", "2023-02-17T12:00:00.123456789Z", "2023-02-17T12:00:00.12+02:00", "2023-02-16T00:00:00-00:00", "2023-02-18T00:00:00", "garbage", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("ts", parse_timestamp(F.col("t")))
    got = [r["age"] for r in df.orderBy("i").select(age_days(F.col("ts")).alias("age")).collect()]
    assert got[0] == 1.0 and abs(got[1] * 86400 - 43200.123456) < 1e-6 and abs(got[2] * 86400 - 36000.12) < 1e-6 and got[3] == -1.0 and got[4:] == [None] * 4


def test_words_equal_pythons(spark):
    texts = ["Ça va? x ab AB a_b 12 don't naïve", "", "é éé ÉÉ", "one\ntwo\tone"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(distinct_words(F.col("t")).alias("w"))
    assert [set(r["w"]) for r in df.collect()] == [set(re.findall(r"\b\w{2,}\b", t.lower())) for t in texts]


@pytest.mark.parametrize("stretch", [0.5, 28.0, 1e9])
def test_spread_against_numpy(spark, stretch):
    rng = random.Random(3)
    times = {f"w{i}": [rng.choice([1, 10, 300]) * rng.random() - 20 for _ in range(rng.randrange(1, 60))] for i in range(40)} | {"same": [2.5] * 9, "two": [1.0, 2.0], "three": [1.0, 2.0, 4.0]}
    df = spark.createDataFrame([(w, t) for w, ts in times.items() for t in ts], "word string, age double")
    got = {r["word"]: (r["occurrences"], r["desvio_padrao"]) for r in words.interval_spread(df, stretch_days=stretch).collect()}
    assert set(got) == {w for w, ts in times.items() if len(ts) >= 3}
    for w, (n, sd) in got.items():
        assert n == len(times[w]) and abs(sd - np.std(np.diff(sorted(times[w])))) < 1e-9 * (1 + sd)
    assert words.interval_spread(df.where("word = 'two'")).collect() == []


def test_histogram_edges(spark):
    values = [0.0, 0.05, 0.1, 1.0, 10_000.0, 10_001.0, None]
    got = words.spread_histogram(spark.createDataFrame([(v,) for v in values], "desvio_padrao double")).collect()
    assert sum(r["n"] for r in got) == 3 and abs(sum(r["p"] for r in got) - 1) < 1e-12 and max(r["bin"] for r in got) == 498 and min(r["bin"] for r in got) == 0


def test_caps_vocabularies_and_odd_posts(spark):
    day = lambda d: datetime.datetime(2023, 3, d, tzinfo=UTC)
    posts = spark.createDataFrame([(1, "u", day(1), "alpha beta"), (2, "u", day(2), "alpha alpha"), (3, "v", None, "gamma"), (4, "v", day(3), ""), (5, "v", day(4), None), (6, "u", day(2), "x")], "post_id long, user string, created_at timestamp, text string")
    assert {r["post_id"] for r in words.newest_posts(posts, 2).where("user = 'u'").collect()} == {2, 6}
    users = spark.createDataFrame([("u",), ("v",)], "user string")
    w = words.post_words(posts)
    assert {tuple(r) for r in words.vocabulary_sizes(users, w).collect()} == {("u", 2), ("v", 0)}
    assert {tuple(r)[:2] for r in words.word_counts(w).collect()} == {("alpha", 2), ("beta", 1)}
    text = posts.withColumn("created_at", F.lit("2023-03-01T00:00:00.1234567Z"))
    assert words.with_time(text).schema["created_at"].dataType.typeName() == "timestamp"


def test_writers_are_those_of_words(spark):
    from orbweave.operators import words

    texts = ["ab", "a b", "", None, "İİ", "é", "éé", "x\u0301y", "__", "4 2", "Σ9", "B!", "\u4e2d\u6587", "!?"]
    posts = spark.createDataFrame([(k, f"u{k}", "2024-01-01T00:00:00Z", t) for k, t in enumerate(texts)], "post_id long, user string, created_at string, text string")
    posts = words.with_time(posts)
    rows = lambda df: sorted(r["user"] for r in df.select("user").distinct().collect())
    plan = words.writers(posts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("[A-Za-z0-9_]{2}") < plan.index("lower(text")  # lower case only where it is needed
    assert rows(words.writers(posts)) == rows(words.post_words(posts)) and len(rows(words.writers(posts))) == 5


@pytest.mark.parametrize("kind,times,stretch", [("long", 2_000_000, 28.0), ("string", 40, 0.5), ("long", 40, 0.5)])
def test_keywords_with_users_leave_a_task_as_one_row(spark, monkeypatch, kind, times, stretch):
    monkeypatch.setattr(words, "TIMES", times)
    monkeypatch.setattr(words, "STRETCH_MICROS", int(stretch * 86_400_000_000))
    rng = random.Random(5)
    user = {"long": [-(1 << 40), -1, 0, 7, 300, None], "string": ["ü", "", "b", None]}[kind]
    day = lambda: datetime.datetime(2023, 2, 15, tzinfo=UTC) + datetime.timedelta(microseconds=rng.randrange(5 * 86_400_000_000))
    made = [(i, rng.choice(user), day() if i % 17 else None, " ".join(["every", *rng.sample([f"w{k}" for k in range(30)], rng.randrange(12)), *["same"] * (i < 3)])) for i in range(90)]
    posts = spark.createDataFrame(made, f"post_id long, user {kind}, created_at timestamp, text string").unionByName(spark.createDataFrame([(91, user[0], None, ""), (92, user[1], day(), "x"), (93, user[1], day(), None)], f"post_id long, user {kind}, created_at timestamp, text string"))
    rows = lambda df: {r["word"]: (r["occurrences"], r["desvio_padrao"], sorted(r["users"])) for r in df.collect()}
    want, got = rows(words.interval_spread(words.post_words(posts), users=True)), rows(words.keyword_users(posts))
    assert set(got) == set(want) and len(got) > 20
    assert all(got[w][0] == n and abs(got[w][1] - sd) < 1e-9 and got[w][2] == u for w, (n, sd, u) in want.items())
    assert words.keyword_users(posts.where("post_id > 90")).collect() == []
    assert "Generate explode" not in words.keyword_users(posts)._jdf.queryExecution().executedPlan().toString()
