"""Operator 5: exact top-k search by inner product, with a uniform threshold in three phases.

The dimensions are split into ``lists`` ranges; a candidate's local score in a list is the inner product over that range, counted from the list's
least score for the query (so that it is not negative), and its score is the sum of its local scores.

1. Each block of each list sends its 2k best local scores for every query, with the scores they belong to. The k-th largest of these, tau, can't
   exceed the k-th best score.
2. The safe cutoff tau / lists goes back to all lists. A candidate below it everywhere sums to less than tau, so the entries at or above
   the cutoff suffice. With them the bounds tighten: what is unseen lies below the cutoff.
3. Candidates whose upper bound reaches the k-th lower bound, and of which a local score is missing, are resolved exactly from their vectors.

Each phase emits what passes its bound, never all pairs; vectors equal to k + 1 candidates of smaller id leave first (they can't be in any result).

Components become floor(scale * x). Defined cases: vectors that are null or empty, or hold null or non-finite components, and rows with a null id, take no
part; a query's own id is no candidate of it; of rows of one id the least vector counts; ties go to the smaller id; a query with fewer than k candidates gets all; candidates
of another dimension are none; an empty table gives an empty result. Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors as V
from .shared import written


def _slices(dim: int, lists: int) -> list[slice]:
    edges = [dim * i // lists for i in range(lists + 1)]
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _local(row: dict, lists: int) -> Iterator[tuple[int, np.ndarray]]:
    """Local scores (candidates x queries) of each list, as int64."""
    c, q = V.as_matrix(row["vectors"], row["dim"]), V.as_matrix(row["q_vectors"], row["q_dim"])
    exact = np.abs(c).max(initial=1) * np.abs(q).max(initial=1) * row["dim"] < 2**53  # then sums of doubles are exact
    if not exact:
        c, q = c.astype(np.int64), q.astype(np.int64)
    for j, part in enumerate(_slices(row["dim"], lists)):
        yield j, (c[:, part] @ q[:, part].T).astype(np.int64)


def top_k_inner(table: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, lists: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each query row's k highest integer inner products.

    is_query: a condition on the table's columns.
    """
    low = np.iinfo(np.int64).min
    whole = lambda df: df.withColumn("v", F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("double")))
    candidates = written(V.packed(V.gathered(V.first_of_equals(whole(V.usable(table, id_col, vector_col)), k + 1), table.count()), V.plain_block, V.PLAIN), "topk-candidates")
    queries = whole(V.usable(table.where(is_query), id_col, vector_col))
    n = queries.count()
    row_bytes = 8 * (2 + (queries.agg(F.max(F.size("v"))).head()[0] or 0) + lists + 1)

    first = 2 * k

    def phase_one(row: dict) -> Iterator[dict]:
        ids, q_ids = V.as_ids(row["ids"]), V.as_ids(row["q_ids"])
        own = ids[:, None] == q_ids[None, :]
        local = dict(_local(row, lists))
        total = sum(local.values())
        for j, s in local.items():
            least = np.where(own, np.iinfo(np.int64).max, s).min(axis=0)
            s[own] = low
            top = np.argpartition(-s, first - 1, axis=0)[:first] if len(ids) > first else np.repeat(np.arange(len(ids))[:, None], len(q_ids), 1)
            fine = np.take_along_axis(s, top, 0) > low
            yield {"query_id": np.broadcast_to(q_ids, top.shape)[fine], "list": np.full(int(fine.sum()), j, np.int32), "vec_id": ids[top][fine], "score": np.take_along_axis(total, top, 0)[fine], "least": np.broadcast_to(least, top.shape)[fine]}

    blocks = V.query_blocks(queries, n=n)
    entries = V.map_rows(V.each_pair(candidates, blocks, row_bytes), phase_one, "query_id long, list int, vec_id long, score long, least long")
    entries = written(entries, "topk-first")
    least = entries.groupBy("query_id", "list").agg(F.min("least").alias("least")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("list", "least"))), lambda x: x["least"]).alias("least"))
    bounds = entries.select("query_id", "vec_id", "score").distinct()
    tau = V.best(bounds, k, F.desc("score"), F.asc("vec_id")).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("tau"))
    base = F.aggregate("least", F.lit(0).cast("long"), lambda a, x: a + x)
    # From here on scores count from the lists' least: at 0 or above, so nothing is cut where there are fewer than k.
    cutoffs = written(tau.join(least, "query_id").select("query_id", F.coalesce(F.col("tau") - base, F.lit(0)).alias("tau"), "least"), "topk-cutoffs")

    def phase_two(row: dict) -> Iterator[dict]:
        ids, q_ids = V.as_ids(row["ids"]), V.as_ids(row["q_ids"])
        cut, least = np.frombuffer(row["tau"], np.int64), np.frombuffer(row["least"], np.int64).reshape(-1, lists)
        own = ids[:, None] == q_ids[None, :]
        for j, s in _local(row, lists):
            s -= least[:, j]
            c, q = np.nonzero((s * lists >= cut) & ~own)
            yield {"query_id": q_ids[q], "list": np.full(len(q), j, np.int32), "vec_id": ids[c], "score": s[c, q]}

    armed = queries.join(cutoffs.select(F.col("query_id").alias("id"), F.array("tau").alias("tau"), "least"), "id")
    blocks = V.query_blocks(armed, {"tau": np.int64, "least": np.int64}, n)
    entries = V.map_rows(V.each_pair(candidates, blocks, row_bytes), phase_two, "query_id long, list int, vec_id long, score long")
    sums = entries.groupBy("query_id", "vec_id").agg(F.sum("score").alias("known"), F.count("*").alias("n_seen"))
    sums = written(sums.join(cutoffs, "query_id").select("query_id", "vec_id", "known", "n_seen", F.aggregate("least", F.lit(0).cast("long"), lambda a, x: a + x).alias("base"), F.ceil(F.col("tau") / lists).alias("cut")), "topk-second")
    kth = V.best(sums, k, F.desc("known"), F.asc("vec_id")).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("known")).otherwise(0).alias("kth"))
    open_ = sums.join(kth, "query_id").where(F.col("known") + (lists - F.col("n_seen")) * F.greatest(F.lit(0), F.col("cut") - 1) >= F.col("kth"))
    done = open_.where(F.col("n_seen") == lists).select("query_id", "vec_id", (F.col("known") + F.col("base")).alias("score"))
    vectors = whole(V.usable(table, id_col, vector_col))
    product = F.aggregate(F.zip_with("v", "w", lambda a, b: a.cast("long") * b.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    missing = open_.where(F.col("n_seen") < lists).select("query_id", "vec_id")
    resolved = (missing.join(vectors.withColumnRenamed("id", "vec_id"), "vec_id").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("w")), "query_id")
                .where(F.size("v") == F.size("w")).select("query_id", "vec_id", product.alias("score")))
    out = V.best(done.union(resolved), k, F.desc("score"), F.asc("vec_id"))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_inner(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
