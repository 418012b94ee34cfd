"""What the two vector searches share: usable vectors, classes of equal vectors, packed blocks, and best entries per query.

Blocks are packed inside the partition that reads them, so vectors are not shuffled to be scanned. Queries are packed into blocks of
bounded size; each candidate block meets each query block. Query blocks are broadcast only while their
total size is under a fixed bound, else both sides are dealt by query block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a block of candidates or queries, and bytes of query blocks that may be broadcast.
CANDIDATES, QUERIES, BROADCAST_BYTES = 4096, 1024, 32 << 20


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of rows with an id and a vector of finite components; of rows of one id, the least vector."""
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return table.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def first_of_equals(rows: DataFrame, keep: int) -> DataFrame:
    """Of rows with equal vectors, the ``keep`` smallest ids.

    Equal vectors tie in any score, and ties go to the smaller id; so a top k that leaves out one id at most
    never needs more than the k + 1 smallest of a class. Spark limits each class before and after its shuffle, so a
    vector that a third of all rows share is cut down where it is read.
    """
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= keep).drop("nth")


def packed(rows: DataFrame, function: Callable[[np.ndarray, np.ndarray], dict], schema: str, size: int = CANDIDATES) -> DataFrame:
    """function(ids, matrix) turns up to ``size`` rows of one dimension into one row of ``schema``. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        for batch in batches:
            lists = batch.column("v")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)
            ids, dims = batch.column("id").to_numpy(), np.diff(offsets)
            for dim in np.unique(dims):
                rows_ = np.flatnonzero(dims == dim)
                matrix = values[offsets[rows_][:, None] + np.arange(dim)]
                part = waiting.setdefault(int(dim), [np.empty(0, np.int64), np.empty((0, dim))])
                part[0], part[1] = np.concatenate([part[0], ids[rows_]]), np.concatenate([part[1], matrix])
                while len(part[0]) >= size:
                    yield pa.RecordBatch.from_pydict({k: [v] for k, v in function(part[0][:size], part[1][:size]).items()})
                    part[0], part[1] = part[0][size:], part[1][size:]
        for ids, matrix in waiting.values():
            if len(ids):
                yield pa.RecordBatch.from_pydict({k: [v] for k, v in function(ids, matrix).items()})

    return rows.select("id", "v").mapInArrow(run, schema)


def gathered(rows: DataFrame, n: int) -> DataFrame:
    """In at most as many partitions as there are full blocks of n rows, so that packing makes few small blocks."""
    return rows.coalesce(max(1, -(-n // CANDIDATES)))


def plain_block(ids: np.ndarray, matrix: np.ndarray) -> dict:
    return {"ids": raw(ids, np.int64), "vectors": raw(matrix, np.float64), "dim": matrix.shape[1]}


PLAIN = "ids binary, vectors binary, dim long"


def query_blocks(queries: DataFrame, extra: dict[str, type] | None = None, n: int | None = None) -> tuple[DataFrame, int, int]:
    """Packed queries (qb, q_dim, q_ids, q_vectors, and the extra columns), their number and their bytes.

    extra: array columns of queries to pack beside the vectors, and the kind of their items.
    """
    extra = extra or {}
    n = queries.count() if n is None else n
    blocks = max(1, -(-n // QUERIES))

    def pack(table: pa.Table) -> pa.Table:
        dims = pa.compute.list_value_length(table["v"]).to_numpy()
        rows = []
        for dim in np.unique(dims):
            part = table.filter(pa.array(dims == dim))
            flat = {c: pa.compute.list_flatten(part[c]).to_numpy() for c in ("v", *extra)}
            rows.append({"qb": part["qb"][0].as_py(), "q_dim": int(dim), "q_ids": raw(part["id"].to_numpy(), np.int64), "q_vectors": raw(flat["v"], np.float64)} | {c: raw(flat[c], kind) for c, kind in extra.items()})
        return pa.Table.from_pylist(rows)

    grouped = queries.select("id", "v", *extra, F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("qb")).groupBy("qb")
    schema = "qb long, q_dim long, q_ids binary, q_vectors binary" + "".join(f", {c} binary" for c in extra)
    return grouped.applyInArrow(pack, schema), blocks, n


def each_pair(candidates: DataFrame, queries: tuple[DataFrame, int, int], row_bytes: int) -> DataFrame:
    """Every candidate block beside every query block of its dimension, by an equi-join on the query block's number.

    row_bytes: of one query; the query side is broadcast only if all of it stays under BROADCAST_BYTES.
    """
    table, blocks, n = queries
    numbered = candidates.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    if n * row_bytes <= BROADCAST_BYTES:
        table = F.broadcast(table)
    return numbered.join(table, "qb").where("dim = q_dim")


def raw(array: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(array, kind).tobytes()


def as_matrix(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, dim)


def as_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def best(rows: DataFrame, k: int, *order: Column, per: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first k rows of each query, with their rank. Spark limits each task's rows before the shuffle too."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("rank") <= k)


def map_rows(df: DataFrame, function: Callable[[dict], Iterator[dict]], schema: str) -> DataFrame:
    """function turns a row (a dict) into batches of columns (dicts of arrays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a row is a pair of blocks
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                for out in function(row):
                    yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)
