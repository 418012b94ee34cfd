"""Operator 2: MinHash near-duplicates by SuperMinHash signatures, banding, exact verification and union-find grouping.

1. Each document gets the set of its distinct word shingles, a signature of the set, and a 128-bit name of the set. Documents of one set form a class;
   only its smallest id goes on, so copies cost one grouped minimum, however many there are.
2. Signatures are cut into bands. All that share a band key are linked to the smallest id among them, their leader (a grouped minimum and an equi-join): a
   candidate pair of documents is one whose members have a common leader.
3. The neighbourhood of a leader is verified on full sets: first every member against the leader, then each member that isn't linked to the leader against all others.
   A union-find inside emits a forest of links, never all pairs. Neighbourhoods are cut into blocks of bounded size; members that miss their leader also visit
   the other blocks, so no link is lost by the cut.
4. Connected components of the forest give the groups.

At a similarity of 0.8, a pair escapes all 32 bands of 4 values with probability 5e-8.

Defined cases: words are split at 0x20 and 0x09-0x0D after A-Z is lower-cased; with fewer words than a shingle the whole sequence is the one shingle; a null or empty text, or one
without words, has an empty set and is linked with nothing; rows of one id are one node (each row is returned, with its own set size); a null id is linked with nothing, has a null
component and is kept; repeated rows are copies; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import discard, release_memory, tidy, written
from .superminhash import band_keys, signatures
from .words import U64, mix, rolling, split_words, string_buffers

#: Shingles in a block of a neighbourhood, at most (a larger set is a block of its own).
BLOCK_SHINGLES = 1_000_000
SIZE = 128
#: Ids that may be broadcast.
BROADCAST_IDS = 500_000


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = string_buffers(texts)
    words = split_words(data, offsets, lower=True)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        own = words.hashes[a:b]
        if len(own) >= width:
            out.append(np.unique(mix(rolling(own, width))))
        else:  # shorter sequences are named apart from full shingles by their length
            out.append(mix(rolling(own, len(own)) + U64(len(own))) if len(own) else own)
    return out


def sketches(docs: DataFrame, width: int, rows: int) -> DataFrame:
    """id, n_shingles, h1, h2 (name of the set), bands array<long> of (id, text)."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = shingle_sets(part.column("text"), width)
                first = np.cumsum([0, *map(len, sets)])
                keys = band_keys(signatures(np.concatenate(sets), first, SIZE), rows)
                names = [[int(mix(s ^ U64(salt)).sum(dtype=np.uint64).view(np.int64)) for s in sets] for salt in (0x51, 0xA7F3)]
                bands = [k if len(s) else [] for k, s in zip(keys, sets, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(first), pa.int64()), pa.array(names[0], pa.int64()), pa.array(names[1], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["id", "n_shingles", "h1", "h2", "bands"])
        release_memory()

    return docs.mapInArrow(run, f"id {id_type}, n_shingles long, h1 long, h2 long, bands array<bigint>")


class Forest:
    """Union-find over 0..n-1 that keeps the links which joined two trees."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))


def compare(sets: list[np.ndarray], leader: int | None, asking: list[int] | None, percent: int) -> tuple[list, list[int]]:
    """Links of a forest among the sets, and the members not linked to the leader.

    leader: index of the set that all are compared with first; then those that miss it are compared with all.
    asking: if given, only these are compared with all the others.
    """
    forest, n = Forest(len(sets)), len(sets)
    sizes = np.array([len(s) for s in sets])
    _, dense = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark = np.zeros(int(dense.max(initial=-1)) + 1, np.int32)

    def linked_to(i: int) -> np.ndarray:
        own = dense[starts[i]:starts[i] + sizes[i]]
        mark[own] = 1
        shared = np.add.reduceat(mark[dense], starts)
        mark[own] = 0
        return 100 * shared >= percent * (sizes + sizes[i] - shared)

    missed = list(range(n)) if asking is None else asking
    if leader is not None:
        hit = linked_to(leader)
        for i in np.flatnonzero(hit).tolist():
            forest.join(leader, i)
        missed = np.flatnonzero(~hit).tolist()
    for i in missed:
        for j in np.flatnonzero(linked_to(i)).tolist():
            forest.join(i, j)
    return forest.links, missed


def verified_links(near: DataFrame, sets: DataFrame, percent: int, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (a, b) that span, in each leader's neighbourhood, the same components as all pairs of similar members.

    near: (leader, id, n_shingles), each leader among its own members. sets: (id, shingles), sorted uint64 as bytes.
    """
    id_type = near.schema["id"].dataType.simpleString()
    # Only neighbourhoods of several blocks are looked up: each holds more than block_shingles shingles, so they are few. All others are block 0.
    cut = written(near.groupBy("leader").agg(F.ceil(F.sum("n_shingles") / block_shingles).cast("long").alias("blocks")).where("blocks > 1"), "neardup-cut")
    cut = F.broadcast(cut) if cut.count() <= BROADCAST_IDS else cut
    placed = near.join(cut, "leader", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("block", F.pmod(F.xxhash64("id", "leader"), "blocks"))
    # The leader's set goes to all blocks of its neighbourhood.
    placed = placed.withColumn("block", F.explode(F.when(F.col("id") == F.col("leader"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))))
    members = placed.join(sets, "id").select("leader", "blocks", "block", "id", "shingles")
    frame = lambda table: ([np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()], table["id"])
    shape = f"a {id_type}, b {id_type}, leader {id_type}, blocks long, block long, missed {id_type}"

    def result(ids, links, leader=None, blocks=None, block=None, missed=()):
        a, b = [i for i, _ in links], [j for _, j in links]
        n, none = len(missed), pa.nulls
        kind = ids.type
        return pa.table({
            "a": pa.chunked_array([ids.take(pa.array(a, pa.int64())).combine_chunks(), none(n, kind)], kind), "b": pa.chunked_array([ids.take(pa.array(b, pa.int64())).combine_chunks(), none(n, kind)], kind),
            "leader": pa.chunked_array([none(len(a), kind), pa.array([leader] * n, kind)], kind), "blocks": pa.array([None] * len(a) + [blocks] * n, pa.int64()),
            "block": pa.array([None] * len(a) + [block] * n, pa.int64()), "missed": pa.chunked_array([none(len(a), kind), ids.take(pa.array(list(missed), pa.int64())).combine_chunks()], kind)})

    def within(table: pa.Table) -> pa.Table:
        sets_, ids = frame(table)
        leader, blocks_, block = (table[c][0].as_py() for c in ("leader", "blocks", "block"))
        links, missed = compare(sets_, ids.to_pylist().index(leader), None, percent)
        return result(ids, links, leader, blocks_, block, missed if blocks_ > 1 else ())

    first = written(members.groupBy("leader", "block").applyInArrow(tidy(within), shape), "neardup-links")
    links = first.where("missed IS NULL").select("a", "b")
    lonely = first.where("missed IS NOT NULL")
    if lonely.head(1):
        # Neighbourhoods of several blocks: who missed the leader is compared with the other blocks too, some at a time.
        asking = lonely.select("leader", F.col("missed").alias("id"), F.col("block").alias("home"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).where("block <> home")
        asking = asking.join(sets, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
        parts = asking.select("leader", "block", "part").distinct()
        both = members.join(parts, ["leader", "block"]).select("leader", "block", "part", "id", "shingles", F.lit(False).alias("asks")).unionByName(asking.select("leader", "block", "part", "id", "shingles", F.lit(True).alias("asks")))

        def between(table: pa.Table) -> pa.Table:
            sets_, ids = frame(table)
            links_, _ = compare(sets_, None, np.flatnonzero(table["asks"].to_numpy()).tolist(), percent)
            return result(ids, links_)

        links = links.union(both.groupBy("leader", "block", "part").applyInArrow(tidy(between), shape).select("a", "b"))
    return links


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = 4, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """id column, n_shingles, component_id (smallest id reachable), kept (whether that is the id itself).

    width: words in a shingle. percent: similarity from which documents are linked, in hundredths. rows: signature values in a band.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = written(sketches(texts, width, rows), "neardup-sketches")
    full = known.where("n_shingles > 0 AND id IS NOT NULL")
    classes = full.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    # Rows of one id are one node: its other sets stand for it too.
    reps = full.join(classes.select(F.col("rep").alias("id"), "h1", "h2"), ["id", "h1", "h2"], "left_semi").dropDuplicates(["id", "h1", "h2"])
    bands = reps.select("id", "n_shingles", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    near = written(bands.join(shared, "key").select("leader", "id", "n_shingles").distinct(), "neardup-near")
    needed = near.select("id").distinct()
    # Ids of candidates are broadcast only up to a fixed number; beyond it texts and ids meet in a shuffle.
    needed = F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed.hint("shuffle_merge")

    def to_sets(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.tobytes() for s in shingle_sets(part.column("text"), width)], pa.binary())], ["id", "shingles"])
        release_memory()

    id_type = texts.schema["id"].dataType.simpleString()
    sets = written(texts.join(needed, "id", "left_semi").mapInArrow(to_sets, f"id {id_type}, shingles binary").dropDuplicates(["id", "shingles"]), "neardup-sets")
    links = verified_links(near, sets, percent, block_shingles)
    # A class whose smallest id also stands for another set ties both.
    linked = links.union(full.join(classes, ["h1", "h2"]).where("id <> rep AND id IS NOT NULL").join(_repeated(full), "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    parts = connected_components(linked)  # written by now, so what led to the links can go
    for table in (near, sets):
        discard(table)
    named = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    out = known.drop("bands").join(named, ["h1", "h2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), own).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _repeated(rows: DataFrame) -> DataFrame:
    """Ids that stand for more than one set."""
    return rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.a
"""
