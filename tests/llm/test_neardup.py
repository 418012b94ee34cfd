import random
import re

import numpy as np
import pytest

from orbweave.llm.neardup import near_duplicates, op2_near_duplicates
from orbweave.llm.superminhash import EMPTY, band_keys, signatures

SCHEMA = "doc_id long, text string, h1 string, id int, component_id string, bands string"


def brute(rows, width, percent=80):
    lower = {i: i + 32 for i in range(65, 91)}
    sets = {}
    for d, t in rows:
        ws = re.findall("[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[d] = {tuple(ws[i:i + width]) for i in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)} if ws else set()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    holders = {}
    for d in ids:
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    for a in ids:
        for b in {b for s in sets[a] for b in holders[s] if b > a}:
            n = len(sets[a] & sets[b])
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def corpus(seed, n):
    """A large group near one text, chains, copies in another case, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    base = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        ws = list(base)
        for _ in range(rng.randrange(8)):
            ws[rng.randrange(60)] = word()
        rows.append((i * 3, " ".join(ws)))
    ws = [word() for _ in range(80)]
    for i in range(15):
        rows.append((5000 + i, "\t".join(ws)))
        ws[rng.randrange(80)] = word()
    rows += [(6000 + i, " ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    rows += [(7000, None), (7001, ""), (7002, " \n"), (7003, "One"), (7004, "oNE"), (7005, "one two"), (7006, "É x"), (7007, "é x"), (7008, rows[0][1].upper()), (7009, "long " + " ".join(str(i) for i in range(60_000))), (7010, " ".join(str(i) for i in range(60_000)))]
    return rows


@pytest.mark.parametrize("width,block", [(2, 2_000_000), (5, 2_000_000), (2, 700)])
def test_against_brute_force(spark, width, block):
    rows = corpus(width, 150)
    df = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA).repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, width, block_shingles=block).collect()}
    assert got == brute(rows, width)


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c"), (None, "a b c"), (4, "a b c"), (4, "a b c"), (9, "A B C"), (4, "other words here"), (8, "other words here")]
    df = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)
    got = sorted(((r["doc_id"] or -1), r["component_id"], r["kept"]) for r in near_duplicates(df, 2).collect())
    assert got == [(-1, None, True), (-1, None, True), (4, 4, True), (4, 4, True), (4, 4, True), (8, 4, False), (9, 4, False)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_against_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in op2_near_duplicates(spark, sf).collect()}
    assert got == brute(rows, 2)


def test_signatures_estimate_similarity_with_less_variance():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(300):
        pool = rng.integers(0, 2**64, 60, dtype=np.uint64)
        a, b = np.unique(pool[:50]), np.unique(pool[10:])
        s = signatures(np.concatenate([a, b, a[:0]]), np.array([0, 50, 100, 100]))
        errors.append((s[0] == s[1]).mean() - 40 / 60)
        assert (s[2] == EMPTY).all()
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.9 * (2 / 3) * (1 / 3) / 128  # independent minima would have this variance without the factor


def test_signatures_do_not_depend_on_grouping():
    rng = np.random.default_rng(1)
    sizes = [1, 3, 200, 40_000, 5, 0, 17]
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in sizes]
    together = signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    for i, s in enumerate(sets):
        assert (signatures(s, np.array([0, len(s)]))[0] == together[i]).all()
    assert len(np.unique(band_keys(together, 4))) == 7 * 32
