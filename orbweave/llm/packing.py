"""Operator 7: harmonic packing of tokenised documents into sequences of a fixed capacity.

A document's ids (with a closing id) are cut into pieces. Full pieces of ``capacity`` ids are sequences
of their own. What remains, r ids, belongs to the reciprocal-capacity class k with
capacity/(k+1) < r <= capacity/k; a bin of class k takes exactly k pieces, so every worker fills its own
bins without knowing the others. If k pieces of r ids would leave more than ``slack`` of a bin
empty, a head of exactly capacity//(k+1) ids is cut for class k+1 and the rest is classed again. Pieces
of at most capacity/LAST_CLASS ids share one class that is filled next-fit, cutting at the brim. When a worker's
rows end, what its unfilled bins hold is laid end to end into full sequences, and the last stretch into sequences of
powers of two, which need no padding.

One narrow pass: nothing is shuffled, and a worker holds at most LAST_CLASS open bins.
sequence_id is the partition number times 2**40 plus a counter, so it is unique without coordination.

Defined cases: a null text counts as empty, and an empty document is the closing id alone; a null id stays null;
repeated rows are packed each; an empty table gives an empty result; other columns are ignored. The input must
give each partition the same rows in the same order when recomputed (a scan, or a sorted or written table),
else a lost executor could number sequences anew.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import release_memory

LAST_CLASS = 32


class Encoder:
    """Ids of texts as little-endian uint32 bytes, equal to those of ``tokenizers`` for the given file.

    A plain byte-level BPE (whose ids follow its merges) is also run by tiktoken on the very same ranks, which takes a quarter
    of the time. Texts that hold an added token, and files of any other kind, go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = self._byte_level(spec)
        del spec
        release_memory()  # the file's objects take more than the ranks made of them

    @property
    def tokenizer(self):
        """Loaded when a text first needs it."""
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow

    @staticmethod
    def _byte_level(spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if not plain or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        # Byte-level alphabets write printable bytes as themselves and the others, in order, from code point 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}
        pieces = {"".join(m) if isinstance(m, list) else m.replace(" ", ""): i for i, m in enumerate(model["merges"])}
        ranks = {}
        for piece, id_ in model["vocab"].items():
            if any(c not in byte_of for c in piece) or len(piece) > 1 and pieces.get(piece) != id_ - 256:
                return None
            ranks[bytes(byte_of[c] for c in piece)] = id_
        import public_tokenizers
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self._one(x) for x in texts]

    def _one(self, text: str) -> bytes:
        if self.fast is not None and not any(t in text for t in self.added):
            return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


class HarmonicPacker:
    """Bins of one worker. Pieces are (document, start, length); a closed bin is a list of them."""

    def __init__(self, capacity: int, slack: float):
        self.capacity, self.slack = capacity, int(capacity * slack)
        self.open: dict[int, list] = {}
        self.small: list = []
        self.small_size = 0
        self.closed: list[list] = []

    def add(self, document, n: int) -> None:
        start, capacity = 0, self.capacity
        while n - start >= capacity:
            self.closed.append([(document, start, capacity)])
            start += capacity
        while n > start:
            rest = n - start
            k = capacity // rest
            if k >= LAST_CLASS:
                self._next_fit(document, start, rest)
                break
            size = rest
            if capacity - k * rest > self.slack:
                k += 1
                size = capacity // k
            bin_ = self.open.setdefault(k, [])
            bin_.append((document, start, size))
            if len(bin_) == k:
                self.closed.append(self.open.pop(k))
            start += size

    def _next_fit(self, document, start: int, size: int) -> None:
        room = self.capacity - self.small_size
        if size >= room:
            self.closed.append([*self.small, (document, start, room)])
            self.small, self.small_size, start, size = [], 0, start + room, size - room
        if size:
            self.small.append((document, start, size))
            self.small_size += size

    def finish(self) -> None:
        """Lay what open bins hold end to end: full sequences, then powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]] + self.small
        self.open, self.small, self.small_size = {}, [], 0
        total = sum(p[2] for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        at = 0
        for size in sizes:
            bin_ = []
            while size:
                document, start, n = left[at]
                take = min(n, size)
                bin_.append((document, start, take))
                size -= take
                if take == n:
                    at += 1
                else:
                    left[at] = (document, start + take, n - take)
            self.closed.append(bin_)


PIECES = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, closing_id: int = 0, slack: float = 0.02, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 500_000) -> DataFrame:
    """Pieces: id column, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32 bytes).

    tokenizer: path of a tokenizers file, readable on every worker.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = source.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = Encoder(tokenizer), HarmonicPacker(capacity, slack)
        first, count = TaskContext.get().partitionId() << 40, 0
        closing = struct.pack("<I", closing_id)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count
            rows = {k: [] for k in ("id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}
            for bin_ in packer.closed:
                at = 0
                for (id_, ids), start, n in bin_:
                    for k, v in zip(rows, (id_, start, n, len(ids) // 4, first + count, at, ids[4 * start:4 * (start + n)]), strict=True):
                        rows[k].append(v)
                    at += n
                count += 1
            packer.closed = []
            if rows["start"]:
                yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in rows.items()})

        kinds = {"start": pa.int64(), "length": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "ids": pa.binary()}
        for batch in batches:
            kinds["id"] = batch.schema.field("id").type
            ids, texts = batch.column("id").to_pylist(), batch.column("text")
            lo, size = 0, 0
            lengths = pa.compute.binary_length(texts).to_pylist()
            for hi in range(1, len(ids) + 1):
                size += lengths[hi - 1]
                if size >= batch_chars or hi == len(ids):
                    for id_, tokens in zip(ids[lo:hi], encode(texts.slice(lo, hi - lo).to_pylist()), strict=True):
                        tokens += closing
                        packer.add((id_, tokens), len(tokens) // 4)
                    lo, size = hi, 0
                    yield from flush()
        packer.finish()
        yield from flush()
        del encode, packer
        release_memory()

    out = source.mapInArrow(run, f"id {id_type.simpleString()}, {PIECES}")
    return out.withColumnRenamed("id", id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_table(docs: DataFrame) -> DataFrame:
    """The contract's columns for a table of documents."""
    import public_tokenizers

    out = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
