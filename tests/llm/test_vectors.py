import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.llm import onebit, topk

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, dim int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "clash", 2) for i, v in rows], SCHEMA).repartition(3)


def usable(rows):
    fine = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    return list(dict(sorted(fine, reverse=True)).items())


def brute_inner(rows, every, k):
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in usable(rows)]
    out = []
    for q, a in dict(rows).items():
        if q % every == 0:
            scores = sorted((-sum(map(int.__mul__, a, b)), i) for i, b in rows if i != q and len(a) == len(b))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def brute_near(rows, every, k):
    rows = [(i, v) for i, v in usable(rows) if any(v)]
    out = []
    for q, a in rows:
        if q % every == 0:
            near = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b))), i) for i, b in rows if i != q and len(a) == len(b))
            out += [(q, n, i, d) for n, (d, i) in enumerate(near[:k], 1)]
    return sorted(out)


def odd_rows(seed, n=400, dim=12):
    rng = random.Random(seed)
    pool = [[rng.gauss(0, 0.2) for _ in range(dim)] for _ in range(60)]
    rows = [(i, rng.choice(pool) if rng.random() < 0.5 else [rng.gauss(0, 0.2) for _ in range(dim)]) for i in range(n)]
    rows += rows[:20] + [(50, pool[2]), (7, pool[3])] + [(n + i, pool[0]) for i in range(100)] + [(n, pool[0])] * 9 + [(None, pool[1]), (5000, None), (5050, []), (5100, [None] * dim), (5150, [float("nan")] * dim), (5200, [float("inf")] * dim), (5250, [0.1] * 3), (5251, [0.2] * 3), (5300, [0.0] * dim)]
    return rows


@pytest.mark.parametrize("lists", [1, 2, 3])
def test_exact_top_k(spark, lists):
    rows = odd_rows(lists)
    got = topk.top_k_inner(frame(spark, rows), F.col("vec_id") % 50 == 0, lists=lists).collect()
    assert sorted(map(tuple, got)) == brute_inner(rows, 50, 5)


def test_exact_top_k_of_few_rows(spark):
    rows = [(0, [1.0, -1.0]), (1, [1e9, 5e8]), (50, [1.0, -1.0]), (51, [1.0, -1.0])]
    got = topk.top_k_inner(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == brute_inner(rows, 50, 5)
    assert topk.top_k_inner(frame(spark, []), F.lit(True)).collect() == []
    assert onebit.nearest(frame(spark, []), F.lit(True)).collect() == []


def same(got, want):
    got = sorted(map(tuple, got))
    return [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 1e-12 for a, b in zip(got, want))


def test_nearest_of_odd_rows(spark):
    rows = odd_rows(9)
    got = onebit.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, epsilon=6.0).collect()
    assert same(got, brute_near(rows, 50, 10))
    few = [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (100, [1.0, 2.0])]
    assert same(onebit.nearest(frame(spark, few), F.col("vec_id") % 50 == 0).collect(), brute_near(few, 50, 10))


def test_recall_of_the_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    rows = np.stack(table["embedding"]).astype(np.float64)
    ids = table["vec_id"].to_numpy()
    got = onebit.op9_one_bit_ann(spark, "/root/testdata/sf0.1").toPandas()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((rows - rows[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        assert np.allclose(mine["score"], [d[ids == i][0] for i in mine["vec_id"]], atol=1e-12)
        hits, total = hits + len(set(want) & set(mine["vec_id"])), total + 10
    assert hits >= 0.98 * total


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((2000, 32)), rng.standard_normal((5, 32))
    turned = x @ onebit.rotation(32, 256, 0).T
    norms = np.linalg.norm(x, axis=1)
    row = {"dim": 32, "codes": np.packbits(turned > 0, axis=1).tobytes(), "norms": norms.tobytes(), "ips": (np.abs(turned).sum(1) / 16 / norms).tobytes(), "q_vectors": q.tobytes()}
    d, error = onebit.estimates(row, {}, 256, 0, 3.0)
    true = ((x[:, None] - q[None]) ** 2).sum(2)
    assert (np.abs(d - true) <= error).mean() > 0.99 and abs((d - true).mean()) < 0.05 * true.mean()
