"""Operator 4: SentencePiece encoding and decoding with a unigram model.

The pieces of a model file and their log scores are laid out as a double-array trie over bytes. A text gets its whitespace marker (a space
becomes U+2581, and one stands before the text if the model says so), and the Viterbi algorithm picks the segmentation with the largest sum of scores; a character that
no piece covers costs the least score minus 10 and becomes one byte piece for each of its bytes (or the unknown piece, if the model has no byte pieces).

No piece has a marker after another character, so texts fall apart at those places without changing the best segmentation, and runs that were met
before come from a bounded cache, found by their hash. All new runs of a batch are walked through the trie at once (every start position, one byte deeper at a time) and solved together.

Decoding joins pieces, turns byte pieces into bytes and markers into spaces, and drops the leading marker; bytes that are not UTF-8 become U+FFFD.

Defined cases: a null text gives null ids and decodes to null; an empty text has no pieces; an unknown id decodes to nothing, and control pieces too; repeated rows are encoded
each; an empty table gives an empty result; other columns are kept as they are. The model's normalisation must be the identity (others are refused).
"""

from __future__ import annotations

import struct
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import release_memory
from .words import BASE, CHUNK, VALUES, mix, powers, string_buffers

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNKNOWN_PENALTY = 10.0


class Vocabulary(NamedTuple):
    pieces: list[str]
    scores: np.ndarray
    kinds: list[int]
    prefix: bool  #: whether a marker stands before each text


def _fields(data: bytes):
    """(number, value) of each field of a serialized message; values are ints or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = number()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(wire)
            n = number() if n is None else n
            yield tag >> 3, data[at:at + n]
            at += n


def read_model(data: bytes) -> Vocabulary:
    """Numbers of the fields of a SentencePiece model file (pieces 1: piece 1, score 2, type 3; normalizer 3: charsmap 2, prefix 3, extra blanks 4)."""
    pieces, scores, kinds, prefix = [], [], [], True
    for field, value in _fields(data):
        if field == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0])
            kinds.append(piece[3])
        elif field == 3:
            spec = {2: b"", 3: 1, 4: 1} | dict(_fields(value))
            if spec[2] or spec[4]:
                raise ValueError("only models whose normalisation is the identity are supported")
            prefix = bool(spec[3])
    return Vocabulary(pieces, np.array(scores, np.float32), kinds, prefix)


class DoubleArray(NamedTuple):
    """state's child by byte c is t = base[state] + c + 1 if check[t] == state; value[t] is the id of the key that ends there, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> DoubleArray:
        root: dict = {}
        for key, id_ in keys.items():
            node = root
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = id_
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        queue, free = [(0, root)], 1
        for state, node in queue:
            value[state] = node.pop(-1, -1)
            if not node:
                continue
            codes = sorted(node)
            at, full, tried = max(free, codes[0] + 1), 0, 0
            while True:
                tried += 1
                if check[at] >= 0:
                    full, at = full + 1, at + 1
                    if at + 258 > size:
                        base += [0] * size
                        check += [-1] * size
                        value += [-1] * size
                        size *= 2
                    continue
                b = at - codes[0] - 1
                if b + codes[-1] + 2 > size:
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
                    size *= 2
                if all(check[b + c + 1] < 0 for c in codes):
                    break
                at += 1
            if tried > 16 and full >= 0.9 * tried:  # a crowded stretch is left behind
                free = at
            base[state] = b
            for c in codes:
                check[b + c + 1] = state
                queue.append((b + c + 1, node[c]))
        return cls(np.array(base + [0] * 258, np.int32), np.array(check + [-1] * 258, np.int32), np.array(value + [-1] * 258, np.int32))

    def matches(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, id) of every key in data that starts at a character and stays before ends[start]."""
        start = np.flatnonzero((data & 0xC0) != 0x80)
        state, depth, found = np.zeros(len(start), np.int32), 0, []
        while len(start):
            alive = start + depth < ends[start]
            start, state = start[alive], state[alive]
            to = self.base[state] + data[start + depth] + 1
            alive = self.check[to] == state
            start, state = start[alive], to[alive]
            depth += 1
            id_ = self.value[state]
            hit = id_ >= 0
            found.append((start[hit], np.full(int(hit.sum()), depth), id_[hit]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then those of starts[1], ..."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the spans that lie in order in data."""
    out, at = np.empty(len(starts), np.uint64), 0
    inverse = pow(BASE, -1, 1 << 64)
    while at < len(starts):
        lo = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, lo + CHUNK, side="right")))
        hi = ends[stop - 1]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(VALUES[data[lo:hi]] * powers(BASE, hi - lo), out=sums[1:])
        s, e = starts[at:stop] - lo, ends[at:stop] - lo
        out[at:stop] = (sums[e] - sums[s]) * powers(inverse, hi - lo)[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        at = stop
    return mix(out)


class Unigram:
    """Encoder and decoder of one vocabulary. Picklable: workers get the arrays.

    Inside, a marker is the byte of a space. Runs are known by a 64-bit hash of their bytes.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = 400_000):
        self.vocabulary, self.most = vocabulary, most
        kinds = np.array(vocabulary.kinds)
        plain = [p.replace(MARK, " ") for p in vocabulary.pieces]
        usable = {p.encode(): i for i, (p, k) in enumerate(zip(plain, vocabulary.kinds, strict=True)) if k in (NORMAL, USER) and p}
        self.trie = DoubleArray.build(usable)
        normal = vocabulary.scores[kinds == NORMAL]
        self.unknown_score = np.float32(normal.min(initial=0) - UNKNOWN_PENALTY)
        self.cost = vocabulary.scores.copy()
        for i in np.flatnonzero(kinds == USER):
            self.cost[i] = len(vocabulary.pieces[i].encode()) * normal.max(initial=0) - 0.1
        self.bytes = {int(vocabulary.pieces[i][3:5], 16): int(i) for i in np.flatnonzero(kinds == BYTE)}
        self.unknown = int(np.flatnonzero(kinds == UNKNOWN)[0])
        self.apart = all(MARK not in p.lstrip(MARK) for p in vocabulary.pieces)
        self.lines_apart = not any("\n" in p for p in vocabulary.pieces)
        surface = {k: str.encode for k in (NORMAL, USER, UNUSED)} | {BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.surface = [surface.get(k, lambda p: b"")(p) for p, k in zip(plain, vocabulary.kinds, strict=True)]
        self._forget()

    def _forget(self) -> None:
        # Hashes of known runs in order, the place and number of their ids, and the ids.
        self.known, self.at, self.count, self.pool = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        ids, ends = self.encode_all(pa.array(texts, pa.string()))
        raw, cuts = ids.astype("<u4").tobytes(), (ends * 4).tolist()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the borders between texts."""
        data, offsets = string_buffers(texts)
        if MARK.encode() in data.tobytes():  # a marker in a text reads as a space
            data, offsets = string_buffers(pa.compute.replace_substring(texts.fill_null(""), MARK, " "))
        sizes = np.diff(offsets)
        if self.vocabulary.prefix and len(data):
            full = np.flatnonzero(sizes > 0)
            data = np.insert(data, offsets[full], 32)
            sizes = sizes + (sizes > 0)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
        if len(data) == 0:
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = self._runs(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes, first, run = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, hashes)
        new = place >= len(self.known)
        new[~new] = self.known[place[~new]] != hashes[~new]
        if len(self.known) and len(self.known) + int(new.sum()) > self.most:
            self._forget()
            new[:] = True
        if new.any():
            a, b = starts[first[new]], ends[first[new]]
            flat = spread(a, b - a)
            ids, count = self.best(data[flat], np.concatenate([[0], np.cumsum(b - a)]))
            at = len(self.pool) + np.cumsum(count) - count
            self.known, self.at, self.count = (np.concatenate(x) for x in ((self.known, hashes[new]), (self.at, at), (self.count, count)))
            self.pool = np.concatenate([self.pool, ids.astype(np.uint32)])
            order = np.argsort(self.known, kind="stable")
            self.known, self.at, self.count = self.known[order], self.at[order], self.count[order]
        place = np.searchsorted(self.known, hashes)[run]
        count = self.count[place]
        total = np.concatenate([[0], np.cumsum(count)])
        return self.pool[spread(self.at[place], count)], total[np.searchsorted(starts, offsets)]

    def _runs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where runs start: at documents, at a marker after something else, and around line ends."""
        begin = np.zeros(len(data), bool)
        if self.apart:
            blank = data == 32
            begin[1:] = blank[1:] & ~blank[:-1]
            if self.lines_apart:
                line = data == 10
                begin |= line
                begin[1:] |= line[:-1]
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(begin)

    def best(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over runs that lie end to end, all at once, one start position after the other: their ids, and how many each has."""
        n_runs, sizes = len(first) - 1, np.diff(first)
        run = np.repeat(np.arange(n_runs), sizes)
        start, length, id_ = self.trie.matches(data, first[run + 1])
        # A character that is no piece by itself can still be passed, as unknown.
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(np.append(heads, len(data)))
        by_head = np.zeros(len(data), np.int64)
        by_head[heads] = width
        single = np.zeros(len(data), bool)
        single[start[length == by_head[start]]] = True
        lost = ~single[heads]
        start, length = np.concatenate([start, heads[lost]]), np.concatenate([length, width[lost]])
        score = np.concatenate([self.cost[id_], np.full(int(lost.sum()), self.unknown_score, np.float32)])
        id_ = np.concatenate([id_, np.full(int(lost.sum()), -1)])
        local = start - first[run[start]]
        order = np.argsort(local, kind="stable")
        start, length, score, id_, local = start[order], length[order], score[order], id_[order], local[order]
        source = start + run[start]  # a place more for each run: its end
        target = source + length
        value = np.full(len(data) + n_runs, -np.inf, np.float32)
        came, what = np.zeros(len(value), np.int64), np.full(len(value), -1)
        value[first[:-1] + np.arange(n_runs)] = 0
        edges = np.flatnonzero(np.diff(local, prepend=-1, append=-2))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            got = value[source[lo:hi]] + score[lo:hi]
            to = target[lo:hi]  # of one run and start all targets differ
            better = got > value[to]
            to = to[better]
            value[to], came[to], what[to] = got[better], source[lo:hi][better], id_[lo:hi][better]
        place, begin = first[1:] + np.arange(n_runs), first[:-1] + np.arange(n_runs)
        live, steps = np.arange(n_runs), []
        while len(live):
            p = place[live]
            steps.append((live, what[p], came[p] - live, p - came[p]))
            place[live] = came[p]
            live = live[place[live] > begin[live]]
        owner, ids, at, n = (np.concatenate(x)[::-1] for x in zip(*steps, strict=True))
        order = np.argsort(owner, kind="stable")
        ids, at, n, owner = ids[order], at[order], n[order], owner[order]
        if (ids < 0).any():
            ids, owner = self._fall_back(ids, at, n, owner, data)
        return ids, np.bincount(owner, minlength=n_runs)

    def _fall_back(self, ids, at, n, owner, data):
        """Unknown characters as their bytes."""
        if not self.bytes:
            return np.where(ids < 0, self.unknown, ids), owner
        repeat = np.where(ids < 0, n, 1)
        out, inside = np.repeat(ids, repeat), spread(np.zeros(len(repeat), np.int64), repeat)
        lost = out < 0
        table = np.array([self.bytes.get(b, self.unknown) for b in range(256)])
        out[lost] = table[data[(np.repeat(at, repeat) + inside)[lost]]]
        return out, np.repeat(owner, repeat)

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        n = len(self.surface)
        raw = b"".join([self.surface[i] for i in numbers if i < n])
        if self.vocabulary.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Unigram:
    with open(path, "rb") as file:
        return Unigram(read_model(file.read()))


def encode_pieces(df: DataFrame, model: Unigram, text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """df with the ids of the best segmentation (little-endian uint32 bytes)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        parts = []
        for lo in range(0, len(column), 1000):
            part = column.slice(lo, 1000)
            ids, ends = shared.value.encode_all(part)
            offsets = pa.py_buffer((ends * 4).astype(np.int64))
            valid = pa.array(part.is_valid().to_numpy(zero_copy_only=False))
            whole = pa.Array.from_buffers(pa.large_binary(), len(part), [None, offsets, pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
            parts.append(pa.compute.if_else(valid, whole, pa.scalar(None, pa.large_binary())).cast(pa.binary()))
        release_memory()
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    return df.withColumn(ids_col, run(F.col(text_col)))


def decode_pieces(df: DataFrame, model: Unigram, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """df with the text that ids stand for."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else shared.value.decode(x) for x in column.to_pylist()], pa.string())

    return df.withColumn(text_col, run(F.col(ids_col)))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = load(public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decode_pieces(encode_pieces(docs, model), model)
    return out.select("doc_id", (F.octet_length("piece_ids") / 4).cast("long").alias("n_pieces"), F.crc32("piece_ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))
