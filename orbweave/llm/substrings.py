"""Operator 10: removal of repeated passages, by Rabin-Karp hashes of every fixed-length word window.

Documents are dealt to blocks by a hash of id and text. In a first round a block sends the distinct hashes of all its windows, dealt by their highest bits to buckets
and packed as sorted differences; a bucket answers every block with one bit a hash: does another block hold it? These hashes have eight bits more than the
number of windows needs, so that a false yes is rare, and costs only a visit to the second round. There, windows that may repeat are told apart by 128 bits: 64 of the Rabin-Karp hash
of their bytes, and 64 of a second one over cryptographic digests of their words, which no made-up words bring to agree. Each such key travels with its place (the id) in
the block's first document that holds it; the bucket finds the least place of each key and answers with one bit a key: is the block's own place a later one? The block then
knows for each window whether its words also start earlier, and overlapping repeated windows merge into maximal removal intervals.

Texts are shuffled once (all three uses read the same exchange), window hashes once, keys and places of windows that may repeat once, answers as bits. A hash that a third of
all documents share is sent once a block, so no bucket is hot; blocks and buckets are sized from the corpus so that both stay within a fixed memory. The driver sees
two numbers (rows and bytes) and whether ids repeat; no list, literal or broadcast grows with the corpus. Nothing is dropped or sampled.

Defined cases: a null or empty text has no words and stays as it is (empty); documents with fewer words than a window lose nothing;
rows of one id are taken in order of a hash of their text, and the later of two equal rows repeats the earlier; null ids sort first and count as one id; an empty
table gives an empty result; other columns are ignored. Rows of one id are spread by their texts; only equal rows (id and text) share a block.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import tidy
from .words import SPACE, Words, rolling, split_words, string_buffers, mix

#: Bytes of text in a block, and window hashes in a bucket, on average.
BLOCK_BYTES, BUCKET_WINDOWS = 2_000_000, 1_000_000
#: Bits by which hashes of the first round exceed what numbers their windows: one window in 2**8 meets a stranger there.
SPARE_BITS = 8
#: Odd base of the second hash.
OTHER_BASE = 0xC2B2AE3D27D4EB4F


def pack(values: np.ndarray) -> bytes:
    """Sorted uint64 as first value, count of bytes a difference, and the differences' low bytes by place."""
    if len(values) == 0:
        return b""
    steps = np.diff(values)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 0  # equal values are steps of 0
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T) if width else np.empty(0, np.uint8)
    return values[:1].tobytes() + bytes([width]) + planes.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    width = blob[8]
    planes = np.frombuffer(blob, np.uint8, offset=9)
    n = len(planes) // width if width else 0
    steps = np.zeros((n, 8), np.uint8)
    if n:
        steps[:, :width] = planes.reshape(width, n).T
    out = np.empty(n + 1, np.uint64)
    out[0] = np.frombuffer(blob, np.uint64, 1)[0]
    out[1:] = steps.reshape(-1).view(np.uint64) if n else out[1:]
    return np.cumsum(out, dtype=np.uint64)


def pack_places(places: np.ndarray) -> bytes:
    """uint64 in any order, as the least, a count of bytes, and the differences' low bytes by place."""
    if len(places) == 0:
        return b""
    least = places.min()
    steps = places - least
    width = (int(steps.max()).bit_length() + 7) // 8
    return least.tobytes() + bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack_places(blob: bytes, n: int) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    steps, width = np.zeros((n, 8), np.uint8), blob[8]
    steps[:, :width] = np.frombuffer(blob, np.uint8, offset=9).reshape(width, n).T
    return np.frombuffer(blob, np.uint64, 1)[0] + steps.reshape(-1).view(np.uint64)


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    """Integers as uint64 of the same order; null is the least."""
    lowest = -(1 << 63)
    values = pa.compute.fill_null(column.cast(pa.int64()), lowest).to_numpy()
    return values.view(np.uint64) ^ np.uint64(1 << 63)


def in_order(table: pa.Table) -> pa.Table:
    """Rows by id, then hash of the text, then text, nulls first."""
    return table.take(pa.compute.sort_indices(table, [("id", "ascending"), ("x", "ascending"), ("text", "ascending")], null_placement="at_start"))


def windows_of(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window that lies within one document, and the index of its first word."""
    hashes = rolling(words.hashes, window)
    begins = np.arange(len(hashes))
    sizes = np.diff(words.first)
    last = np.repeat(words.first[1:], sizes)[:len(hashes)] - window
    inside = begins <= last
    return mix(hashes[inside]), begins[inside]


def digests(data: np.ndarray, words: Words, needed: np.ndarray) -> np.ndarray:
    """64 bits of a cryptographic digest of each needed word (a mask), 0 for the others."""
    sizes = words.ends - words.starts
    letters = data[~SPACE[data]][np.repeat(needed, sizes)]
    offsets = np.concatenate([[0], np.cumsum(sizes[needed])]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    values = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in coded.dictionary.to_pylist()), np.uint64)
    out = np.zeros(len(sizes), np.uint64)
    out[needed] = values[coded.indices.to_numpy()]
    return out


def second_hashes(data: np.ndarray, words: Words, begins: np.ndarray, window: int) -> np.ndarray:
    """Hash over the words' digests of the windows that begin at the given words."""
    if len(begins) == 0:
        return np.empty(0, np.uint64)
    covered = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(covered, begins, 1)
    np.add.at(covered, begins + window, -1)
    return mix(rolling(digests(data, words, np.cumsum(covered[:-1]) > 0), window, OTHER_BASE)[begins])


def by_key(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the keys (equal ones as they come), and which of the ordered ones begin a new key."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    return order, np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])])


def _buckets(values: np.ndarray, bits: int, width: int = 64) -> np.ndarray:
    """Borders of the buckets in sorted values of some width, by their highest bits."""
    if bits == 0:
        return np.array([0, len(values)])
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width - bits)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])


def plan_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_windows: int = BUCKET_WINDOWS) -> tuple[int, int, int]:
    """Number of blocks, of hash bits that name a bucket, and of hash bits that the first round sends."""
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / 6 / bucket_windows))))
    return max(1, math.ceil(size / block_bytes)), bits, min(64, max(bits, math.ceil(math.log2(size / 6 + 1))) + SPARE_BITS)


def dedup_passages(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", keep_spacing: bool = False, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """id column, n_words, n_removed, kept, removed array<struct<begin, end>> (ranges of word indexes, half open, maximal).

    kept joins the kept words by one space, or with keep_spacing is the text without the removed stretches, each from its first word
    to the next kept word.
    carry: columns that come along, in a struct column named carried.
    """
    carried = [F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *carried)
    n_blocks, bits, width = plan_blocks(docs, block_bytes, bucket_windows)
    # Only where ids repeat does the place of a window need the hash of its text too.
    repeated_ids = bool(docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").head(1))
    whole = isinstance(docs.schema["id"].dataType, T.IntegralType)
    blocks = docs.withColumn("x", F.xxhash64("text")).withColumn("block", F.pmod(F.xxhash64("id", "x"), F.lit(n_blocks)).cast("int")).select("block", "x", *docs.columns)

    def read(table: pa.Table) -> tuple:
        table = in_order(table)
        data, offsets = string_buffers(table["text"])
        words = split_words(data, offsets)
        return table, data, offsets, words, *windows_of(words, window)

    def short(hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - width)

    def send(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        values = np.unique(short(read(table)[4]))
        edges = _buckets(values, bits, width)
        used = np.flatnonzero(np.diff(edges))
        return pa.table({"bucket": pa.array(used, pa.int32()), "block": pa.array([block] * len(used), pa.int32()), "blob": pa.array([pack(values[edges[b]:edges[b + 1]]) for b in used], pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        """Which hashes of each block are in another one too."""
        table = table.sort_by("block")
        parts = [unpack(v.as_py()) for v in table["blob"]]
        values = np.concatenate(parts)
        order = np.argsort(values, kind="stable")  # parts are sorted runs
        ordered = values[order]
        same = ordered[1:] == ordered[:-1]
        shared = np.zeros(len(values), bool)
        shared[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        edges = np.cumsum([0, *map(len, parts)])
        rows = [(block.as_py(), np.packbits(shared[lo:hi]).tobytes()) for block, lo, hi in zip(table["block"], edges[:-1], edges[1:], strict=True) if shared[lo:hi].any()]
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([table["bucket"][0].as_py()] * len(rows), pa.int32()), "shared": pa.array([r[1] for r in rows], pa.binary())})

    def suspects(hashes: np.ndarray, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Of each window: whether another block may hold it, and whether this one may hold it twice."""
        values, inverse, counts = np.unique(short(hashes), return_inverse=True, return_counts=True)
        shared = np.zeros(len(values), bool)
        edges = _buckets(values, bits, width)
        for bucket, seen in zip(answers["bucket"].to_pylist(), answers["shared"].to_pylist(), strict=True):
            lo, hi = edges[bucket], edges[bucket + 1]
            shared[lo:hi] = np.unpackbits(np.frombuffer(seen, np.uint8), count=hi - lo).astype(bool)
        return shared[inverse], (counts > 1)[inverse]

    def send_keys(table: pa.Table, answers: pa.Table) -> pa.Table:
        sent = {name: [] for name in ("bucket", "block", "shared", "first", "second", "ids", "places", "xs")}
        id_type = table.schema.field("id").type
        if answers.num_rows:
            block = answers["block"][0].as_py()
            table, data, _, words, hashes, begins = read(table)
            outside = suspects(hashes, answers)[0]
            hashes, begins = hashes[outside], begins[outside]
            second = second_hashes(data, words, begins, window)
            order, new = by_key(hashes, second)
            order = order[new]
            hashes, second = hashes[order], second[order]
            holder = np.searchsorted(words.first, begins[order], side="right") - 1  # the first document that holds the window
            places = _unsigned(table["id"])[holder] if whole else None
            x = _unsigned(table["x"])[holder] if repeated_ids else None
            edges = _buckets(hashes, bits)
            for bucket, seen in zip(answers["bucket"].to_pylist(), answers["shared"].to_pylist(), strict=True):
                part = slice(edges[bucket], edges[bucket + 1])
                ids = None if whole else table["id"].take(pa.array(holder[part])).to_pylist()
                row = (bucket, block, seen, pack(hashes[part]), second[part].tobytes(), ids, pack_places(places[part]) if whole else b"", pack_places(x[part]) if repeated_ids else b"")
                for name, value in zip(sent, row, strict=True):
                    sent[name].append(value)
        types = {"bucket": pa.int32(), "block": pa.int32(), "ids": pa.list_(id_type)}
        return pa.table({name: pa.array(values, types.get(name, pa.binary())) for name, values in sent.items()})

    def answer(table: pa.Table) -> pa.Table:
        """Which keys of each block have an earlier place in another one."""
        table = table.sort_by("block")
        parts = [unpack(v.as_py()) for v in table["first"]]
        sizes = [len(p) for p in parts]
        gathered = lambda column: np.concatenate([unpack_places(v.as_py(), n) for v, n in zip(table[column], sizes, strict=True)])
        order, new = by_key(np.concatenate(parts), np.concatenate([np.frombuffer(v.as_py(), np.uint64) for v in table["second"]]))
        again = np.zeros(len(order), bool)
        if not new.all():
            starts, group = np.flatnonzero(new), np.cumsum(new) - 1
            ranks = gathered("places") if whole else pa.compute.rank(pa.compute.list_flatten(table["ids"]), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
            ranks = ranks[order]
            later = ranks > np.minimum.reduceat(ranks, starts)[group]
            if repeated_ids:
                x = np.where(later, np.iinfo(np.uint64).max, gathered("xs")[order])
                later |= x > np.minimum.reduceat(x, starts)[group]
            again[order] = later
        edges = np.cumsum([0, *sizes])
        rows = [(block.as_py(), seen.as_py(), np.packbits(again[lo:hi]).tobytes()) for block, seen, lo, hi in zip(table["block"], table["shared"], edges[:-1], edges[1:], strict=True) if again[lo:hi].any()]
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([table["bucket"][0].as_py()] * len(rows), pa.int32()), "shared": pa.array([r[1] for r in rows], pa.binary()), "later": pa.array([r[2] for r in rows], pa.binary())})

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        table, data, offsets, words, hashes, begins = read(table)
        repeated = np.zeros(len(hashes), bool)
        if len(hashes):
            outside, inside = suspects(hashes, answers)
            chosen = np.flatnonzero(outside | inside)
            first, second = hashes[chosen], second_hashes(data, words, begins[chosen], window)
            order, new = by_key(first, second)
            # As send_keys numbered them: the distinct keys that another block may hold. Equal keys are all outside or all not.
            sent = new & outside[chosen][order]
            earlier = np.zeros(int(sent.sum()), bool)
            edges = _buckets(first[order][sent], bits)
            for bucket, later in zip(answers["bucket"].to_pylist(), answers["later"].to_pylist(), strict=True):
                lo, hi = edges[bucket], edges[bucket + 1]
                earlier[lo:hi] = np.unpackbits(np.frombuffer(later, np.uint8), count=hi - lo).astype(bool)
            known = np.zeros(len(order), bool)
            known[np.flatnonzero(sent)[earlier]] = True
            known = known[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            repeated[chosen[order]] = known | ~new
        change = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(change, begins[repeated], 1)
        np.add.at(change, begins[repeated] + window, -1)
        gone = np.cumsum(change[:-1]) > 0
        n_words, n_removed, kept, removed = np.diff(words.first), [], [], []
        raw = data.tobytes()
        for i in range(table.num_rows):
            a, b = int(words.first[i]), int(words.first[i + 1])
            here = gone[a:b]
            n = int(here.sum())
            text = raw[offsets[i]:offsets[i + 1]]
            spans = []
            if n:
                steps = np.diff(np.concatenate([[0], here.astype(np.int8), [0]]))
                spans = list(zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True))
            if keep_spacing:
                out, at = [], int(offsets[i])
                for lo, hi in spans:
                    out.append(raw[at:words.starts[a + lo]])
                    at = int(words.starts[a + hi]) if a + hi < b else int(offsets[i + 1])
                text = b"".join([*out, raw[at:offsets[i + 1]]]) if spans else text
            else:
                pieces = text.split()
                if n:
                    at, out = 0, []
                    for lo, hi in [*spans, (len(pieces), len(pieces))]:
                        out += pieces[at:lo]
                        at = hi
                    pieces = out
                text = b" ".join(pieces)
            n_removed.append(n)
            kept.append(text)
            removed.append([{"begin": lo, "end": hi} for lo, hi in spans])
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        along = {"carried": table["carried"]} if "carried" in table.column_names else {}
        return pa.table({"id": table["id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "removed": pa.array(removed, span), **along})

    sent = blocks.groupBy("block").applyInArrow(tidy(send), "bucket int, block int, blob binary")
    met = sent.groupBy("bucket").applyInArrow(tidy(meet), "block int, bucket int, shared binary")
    keys = blocks.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(lambda table, answers: tidy(lambda t: send_keys(t, answers))(table), f"bucket int, block int, shared binary, first binary, second binary, ids array<{docs.schema['id'].dataType.simpleString()}>, places binary, xs binary")
    answers = keys.groupBy("bucket").applyInArrow(tidy(answer), "block int, bucket int, shared binary, later binary")
    shape = T.StructType.fromDDL("n_words long, n_removed long, kept string, removed array<struct<begin: bigint, end: bigint>>")
    # The carried columns keep their own types, nullability included.
    shape = T.StructType([T.StructField("id", docs.schema["id"].dataType), *shape.fields, *[T.StructField("carried", docs.schema["carried"].dataType) for _ in carried]])
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda table, answers: tidy(lambda t: cut(t, answers))(table), shape)
    return out.withColumnRenamed("id", id_col)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, word, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS i
  FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents))),
win AS (
  SELECT doc_id, i, md5(string_agg(word, ' ') OVER f) AS k, count(*) OVER f AS n
  FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM win WHERE n = 20) WHERE nth > 1),
marked AS (
  SELECT w.doc_id, w.i, w.word, max(r.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM w LEFT JOIN rep r ON w.doc_id = r.doc_id AND w.i = r.i)
SELECT d.doc_id, count(m.i) AS n_words, count(m.i) FILTER (WHERE m.gone) AS n_removed,
  sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.i) FILTER (WHERE NOT m.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""
