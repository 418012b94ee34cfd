"""Operator 9: approximate nearest neighbours by randomly rotated one-bit codes.

Index (every row): a vector minus the centre is rotated by a seeded random orthonormal map into ``bits`` dimensions and kept as the signs, packed
to bits, with two correction scalars: its norm, and the inner product of the signs' unit vector with the rotated unit vector.

Search: the inner product of a query with a vector is estimated from the packed bits; dividing by the second scalar makes the
estimate unbiased, and its error stays within epsilon * sqrt((1 - ip^2) / ip^2) / sqrt(bits - 1) with high probability. Each query's
2k best estimates are measured exactly; the k-th of these distances is an upper bound of the true k-th, and every candidate whose lower
bound reaches it is reranked on the original vectors. Distances in the result are exact; only a neighbour whose error exceeds its bound can be
missed (recall is measured in tests, and is about 0.999 at epsilon 2.5).

The centre is the mean of a bounded sample (SAMPLE rows, by the hash of the id); it only steers accuracy. Vectors equal to k + 1 others of smaller id can't be
in any result and are left out of the scan.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null id, take no part; a query's own id is no candidate of it; of rows
of one id the least vector counts; ties go to the smaller id; with fewer than k candidates all are returned; candidates of another dimension are none; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors as V
from .shared import written

SAMPLE = 10_000


@lru_cache(maxsize=4)
def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """bits x dim, with orthonormal columns."""
    return np.linalg.qr(np.random.default_rng([seed, dim, bits]).standard_normal((bits, dim)))[0]


def code_bits(dim: int, bits: int) -> int:
    """Whole bytes, and at least as many as dimensions."""
    return -(-max(bits, dim) // 8) * 8


def build_index(rows: DataFrame, bits: int = 256, seed: int = 0, n: int | None = None) -> tuple[DataFrame, dict[int, list[float]]]:
    """Blocks (ids, codes, norms, ips, dim) of usable rows (id, v), and the centre of each dimension."""
    n = rows.count() if n is None else n
    sampled = rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(max(1, n // SAMPLE))) == 0).limit(2 * SAMPLE)
    means = sampled.select(F.size("v").alias("dim"), F.posexplode("v")).groupBy("dim", "pos").agg(F.avg("col").alias("m"))
    centres: dict[int, list[float]] = {}
    for r in means.orderBy("dim", "pos").collect():  # one number for each dimension of the vectors
        centres.setdefault(r["dim"], []).append(r["m"])

    def encode(ids: np.ndarray, matrix: np.ndarray) -> dict:
        dim = matrix.shape[1]
        x = matrix - np.array(centres.get(dim, [0.0] * dim))
        norms = np.sqrt((x * x).sum(1))
        rotated = x @ rotation(dim, code_bits(dim, bits), seed).T
        ips = np.abs(rotated).sum(1) / np.sqrt(rotated.shape[1]) / np.where(norms > 0, norms, 1)
        return {"ids": V.raw(ids, np.int64), "codes": np.packbits(rotated > 0, axis=1).tobytes(), "norms": V.raw(norms, np.float64), "ips": V.raw(np.where(norms > 0, ips, 1), np.float64), "dim": dim}

    return V.packed(rows, encode, "ids binary, codes binary, norms binary, ips binary, dim long"), centres


def estimates(row: dict, centres: dict[int, list[float]], bits: int, seed: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated squared distances (candidates x queries) and their error bounds."""
    dim = row["dim"]
    width = code_bits(dim, bits)
    norms, ips = (np.frombuffer(row[c], np.float64)[:, None] for c in ("norms", "ips"))
    signs = np.unpackbits(np.frombuffer(row["codes"], np.uint8).reshape(-1, width // 8), axis=1).astype(np.float32) * 2 - 1
    q = V.as_matrix(row["q_vectors"], dim) - np.array(centres.get(dim, [0.0] * dim))
    q_norms = np.sqrt((q * q).sum(1))[None, :]
    turned = (q @ rotation(dim, width, seed).T).astype(np.float32)
    inner = norms * ((signs @ turned.T) / np.sqrt(width) / ips)
    error = 2 * norms * q_norms * np.sqrt(np.maximum(0, 1 - ips**2)) / ips * epsilon / np.sqrt(width - 1)
    return norms**2 + q_norms**2 - 2 * inner, error + 1e-5 * (norms**2 + q_norms**2)


def _own(row: dict) -> np.ndarray:
    return V.as_ids(row["ids"])[:, None] == V.as_ids(row["q_ids"])[None, :]


def nearest(table: DataFrame, is_query: Column, k: int = 10, bits: int = 256, epsilon: float = 2.5, seed: int = 0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) for each query row's k nearest found.

    is_query: a condition on the table's columns.
    """
    nonzero = lambda df: df.where(F.exists("v", lambda x: x != 0))
    rows = nonzero(V.usable(table, id_col, vector_col))
    index, centres = build_index(V.gathered(V.first_of_equals(rows, k + 1), n_rows := table.count()), bits, seed, n_rows)
    index = written(index, "onebit-index")
    queries = nonzero(V.usable(table.where(is_query), id_col, vector_col))
    n = queries.count()
    row_bytes = 8 * (4 + (queries.agg(F.max(F.size("v"))).head()[0] or 0))

    def closest(row: dict) -> Iterator[dict]:
        ids, q_ids = V.as_ids(row["ids"]), V.as_ids(row["q_ids"])
        d, _ = estimates(row, centres, bits, seed, epsilon)
        d[_own(row)] = np.inf
        top = np.argpartition(d, 2 * k - 1, axis=0)[:2 * k] if len(ids) > 2 * k else np.repeat(np.arange(len(ids))[:, None], len(q_ids), 1)
        score = np.take_along_axis(d, top, 0)
        fine = np.isfinite(score)
        yield {"query_id": np.broadcast_to(q_ids, top.shape)[fine], "vec_id": ids[top][fine], "estimate": score[fine]}

    def measured(pairs: DataFrame) -> DataFrame:
        square = F.aggregate(F.zip_with("v", "w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
        return (pairs.join(rows.withColumnRenamed("id", "vec_id"), "vec_id").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("w")), "query_id")
                .where(F.size("v") == F.size("w")).select("query_id", "vec_id", F.sqrt(square).alias("score")))

    first = V.map_rows(V.each_pair(index, V.query_blocks(queries, n=n), row_bytes), closest, "query_id long, vec_id long, estimate double")
    first = V.best(first, 2 * k, F.asc("estimate"), F.asc("vec_id")).select("query_id", "vec_id").distinct()
    kth = V.best(measured(first), k, F.asc("score"), F.asc("vec_id")).groupBy("query_id").agg(F.when(F.count("*") == k, F.max("score")).otherwise(float("inf")).alias("kth"))
    kth = written(kth, "onebit-bounds")

    def within(row: dict) -> Iterator[dict]:
        ids, q_ids = V.as_ids(row["ids"]), V.as_ids(row["q_ids"])
        d, error = estimates(row, centres, bits, seed, epsilon)
        bound = np.frombuffer(row["kth"], np.float64) ** 2
        c, q = np.nonzero((d - error <= bound * (1 + 1e-9)) & ~_own(row))
        yield {"query_id": q_ids[q], "vec_id": ids[c]}

    armed = queries.join(kth.select(F.col("query_id").alias("id"), F.array("kth").alias("kth")), "id")
    chosen = V.map_rows(V.each_pair(index, V.query_blocks(armed, {"kth": np.float64}, n), row_bytes), within, "query_id long, vec_id long")
    out = V.best(measured(chosen.distinct()), k, F.asc("score"), F.asc("vec_id"))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_one_bit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
