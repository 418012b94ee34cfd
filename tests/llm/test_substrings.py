import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbweave.llm.substrings import dedup_passages, op10_substring_dedup, pack, pack_places, unpack, unpack_places
from orbweave.llm.words import powers, rolling, split_words

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows, window):
    """rows in document order: words, removed flags."""
    seen, out = set(), []
    for _, text in rows:
        ws = WORD.findall(text or "")
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i:i + window])
            if key in seen:
                gone[i:i + window] = [True] * window
            seen.add(key)
        out.append((len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone) if not g)))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randrange(3, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(f"w{rng.randrange(10**6)}é" for _ in range(rng.randrange(40))) for _ in range(rng.randrange(6))]
        rows.append((i * 7, rng.choice([" ", "\n", " \t\r\n"]).join(parts)))
    rows += [(n * 7 + 1, None), (n * 7 + 2, ""), (n * 7 + 3, " \n "), (n * 7 + 4, "again and again " * 300), (n * 7 + 5, "a\xa0b\x85c\x1cd " * 20)]
    return rows


SCHEMA = "doc_id long, text string, block int, id string, kept string"


@pytest.mark.parametrize("window,block_bytes,bucket_windows", [(20, 3000, 300), (5, 20_000, 50_000), (3, 1_000_000, 2_000_000)])
def test_against_brute_force(spark, window, block_bytes, bucket_windows):
    rows = corpus(window, 120)
    shuffled = [(*r, 1, "x", "y") for r in rows]
    random.Random(1).shuffle(shuffled)
    got = {r["doc_id"]: r for r in dedup_passages(spark.createDataFrame(shuffled, SCHEMA), window, block_bytes=block_bytes, bucket_windows=bucket_windows).collect()}
    assert len(got) == len(rows)
    for (d, _), want in zip(rows, brute(rows, window), strict=True):
        r = got[d]
        assert (r["n_words"], r["n_removed"], r["kept"]) == want
        assert sum(s["end"] - s["begin"] for s in r["removed"]) == r["n_removed"]
        assert all(a["end"] < b["begin"] for a, b in zip(r["removed"], r["removed"][1:]))


def test_repeated_rows_null_ids_and_spacing(spark):
    text = " ".join(f"t{i}" for i in range(25))
    rows = [(None, text), (1, f"x\n{text}\ny  z"), (1, f"x\n{text}\ny  z"), (2, text[:40])]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    got = sorted((r["doc_id"] or 0, r["n_removed"], r["kept"]) for r in dedup_passages(df, keep_spacing=True).collect())
    assert got[0] == (0, 0, text) and got[1][:2] == (1, 25) and got[1][2] == "x\ny  z" and got[2][:2] == (1, 28) and got[2][2] == "" and got[3][1:] == (0, text[:40])
    assert dedup_passages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rows_of_few_ids_are_spread(spark):
    """Ids that repeat, nulls and names as ids: rows are taken by id, then hash of the text."""
    rng = random.Random(5)
    passages = [" ".join(f"{rng.choice('abc')}{rng.randrange(50)}" for _ in range(30)) for _ in range(6)]
    texts = [" ".join(rng.choice(passages) if rng.random() < 0.7 else f"u{rng.randrange(10**6)}" for _ in range(4)) for _ in range(150)]
    for kind, ids in (("long", [None, 5, 7, -3]), ("string", [None, "b", "", "a"])):
        df = spark.createDataFrame([(rng.choice(ids), t) for t in texts], f"doc_id {kind}, text string")
        got = dedup_passages(df, 10, block_bytes=600, bucket_windows=50).collect()
        hashed = [(r["doc_id"], r["text"], r["x"]) for r in df.withColumn("x", F.xxhash64("text")).collect()]
        hashed.sort(key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[2]))
        want = [(d, *w) for (d, _, _), w in zip(hashed, brute([r[:2] for r in hashed], 10), strict=True)]
        assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_words"], r["n_removed"], r["kept"])) for r in got)


def test_plan_does_not_grow_with_the_rows(spark):
    def plan(n):
        df = spark.createDataFrame(corpus(3, n), "doc_id long, text string")
        return len(re.sub(r"\d+", "", dedup_passages(df, 5, block_bytes=500)._jdf.queryExecution().optimizedPlan().toString()))

    assert abs(plan(50) - plan(400)) < 50


def test_query_against_brute_force(spark, sf):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: tuple(r)[1:] for r in op10_substring_dedup(spark, sf).collect()}
    assert got == {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for (d, _), (n, k, t) in zip(rows, brute(rows, 20), strict=True)}


def test_equal_values_are_packed():
    for values in ([7, 7], [0, 0, 0], [3, 3, 9]):
        assert unpack(pack(np.array(values, np.uint64))).tolist() == values


@given(st.sets(st.integers(0, 2**64 - 1), max_size=50))
@settings(max_examples=100, deadline=None)
def test_pack(values):
    array = np.array(sorted(values), np.uint64)
    assert unpack(pack(array)).tolist() == array.tolist()
    assert unpack_places(pack_places(array[::-1]), len(array)).tolist() == array[::-1].tolist()


@given(st.lists(st.text(alphabet=" \n\tab\xa0é\x0b\x1fZ", max_size=30), max_size=5), st.booleans())
@settings(max_examples=200, deadline=None)
def test_words(texts, lower):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    words = split_words(data, np.cumsum([0, *map(len, raw)]), lower)
    found = [b"".join(raw)[a:b] for a, b in zip(words.starts, words.ends)]
    assert found == [w.encode() for t in texts for w in WORD.findall(t)]
    same = {}
    for w, h in zip(found, words.hashes.tolist(), strict=True):
        assert same.setdefault(w.lower() if lower else w, h) == h
    assert len(set(same.values())) == len(same)
    assert np.diff(words.first).tolist() == [len(WORD.findall(t)) for t in texts]


def test_rolling_equals_the_sum():
    values = np.random.default_rng(0).integers(0, 2**64, 100, dtype=np.uint64)
    base = 12345 * 2 + 1
    want = [sum(int(v) * pow(base, 6 - i, 2**64) for i, v in enumerate(values[s:s + 7])) % 2**64 for s in range(94)]
    assert rolling(values, 7, base).tolist() == want and len(powers(base, 3)) == 3


def test_words_that_agree_in_the_first_hash(spark):
    """Words of the Thue-Morse sequence and of its complement have one polynomial hash modulo 2**64, whatever the base; digests tell them apart."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = ("".join("xy"[v ^ flip] for v in bits) for flip in (0, 1))
    words = split_words(np.frombuffer(f"{a} {b}".encode(), np.uint8), np.array([0, 4097]))
    assert words.hashes[0] == words.hashes[1]
    rows = [(1, f"one two {a} three four"), (2, f"one two {b} three four"), (3, f"one two {b} three four"), (4, f"{a} one two {a} one two {b}"), (5, f"{b} one two {b}")]
    want = brute(rows, 3)
    for block_bytes in (1000, 1_000_000):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"), 3, block_bytes=block_bytes, bucket_windows=50).collect()}
        assert [got[d] for d, _ in rows] == want
