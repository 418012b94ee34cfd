import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orbweave.llm.packing import Encoder, HarmonicPacker, op7_packing, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(pieces, want_ids, capacity=1024):
    """Every id in one piece, sequences gapless and within capacity; gives (padding, ids)."""
    docs, sequences = {}, {}
    for p in pieces:
        docs.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append(p)
    assert set(docs) == set(want_ids)
    for d, ps in docs.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(want_ids[d])
            ids = want_ids[d][at:at + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += p["length"]
        assert at == len(want_ids[d])
    padding = 0
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, sum(map(len, want_ids.values()))


def test_query_against_plain_tokenizer(spark, sf):
    tokenizer = Tokenizer.from_file(PATH)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in rows}
    padding, total = check(op7_packing(spark, sf).collect(), want)
    assert padding < 0.03 * total


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab é\n\t \x85　  \x1f'19.<|>ndoftx_")) | st.characters(codec="utf-8"), max_size=40), max_size=6))
@settings(max_examples=300, deadline=None)
def test_fast_ids_equal_plain_ids(texts):
    if not hasattr(test_fast_ids_equal_plain_ids, "t"):
        test_fast_ids_equal_plain_ids.t = Encoder(PATH), Tokenizer.from_file(PATH)
    cached, plain = test_fast_ids_equal_plain_ids.t
    texts = texts + ["a  <|endoftext|> b", "don't  stop\n it's"]
    assert [np.frombuffer(x, "<u4").tolist() for x in cached(texts)] == [plain.encode(x, add_special_tokens=False).ids for x in texts]


def test_fast_ids_of_long_runs():
    fast, plain = Encoder(PATH), Tokenizer.from_file(PATH)
    assert fast.fast is not None
    for text in (" " * 200_000 + "x", "\n" * 100_000, "ab" * 50_000, "!" * 50_000, "é" * 30_000, "1" * 30_000):
        assert np.frombuffer(fast([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_other_files_use_their_own_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = Encoder(path)
    assert encoder.fast is None
    assert np.frombuffer(encoder(["Hello  World"])[0], "<u4").tolist() == Tokenizer.from_file(path).encode("Hello  World", add_special_tokens=False).ids


@given(st.lists(st.integers(1, 3000), max_size=60))
@settings(max_examples=200, deadline=None)
def test_packer_places_each_id_once(lengths):
    packer = HarmonicPacker(1024, 0.02)
    for d, n in enumerate(lengths):
        packer.add(d, n)
    packer.finish()
    at = {}
    for bin_ in packer.closed:
        assert 0 < sum(p[2] for p in bin_) <= 1024
        for d, start, n in bin_:
            at.setdefault(d, []).append((start, n))
    for d, n in enumerate(lengths):
        end = 0
        for start, size in sorted(at[d]):
            assert start == end
            end += size
        assert end == n


def test_edges(spark):
    schema = "doc_id long, text string, ids string, id long, sequence_id string"
    rows = [(1, None, "x", 3, "y"), (2, "", None, None, None), (3, "word " * 30_000, "x", 1, "z"), (4, "same text", "x", 1, "z"), (5, "same text", "x", 1, "z"), (None, "no id", None, 1, None)]
    out = pack_documents(spark.createDataFrame(rows, schema).coalesce(1), PATH).withColumn("ids_crc32", F.crc32("ids"))
    tokenizer = Tokenizer.from_file(PATH)
    check(out.collect(), {r[0]: tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in rows})
    assert pack_documents(spark.createDataFrame([], schema), PATH).collect() == []
    twice = pack_documents(spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string"), PATH).collect()
    assert sum(r["length"] for r in twice) == 2 * twice[0]["doc_tokens"]


@pytest.mark.parametrize("capacity", [64, 1024])
def test_little_padding(capacity):
    rng = np.random.default_rng(1)
    packer, total = HarmonicPacker(capacity, 0.02), 0
    for n in rng.integers(1, 4 * capacity, 4000).tolist():
        packer.add(0, n)
        total += n
    packer.finish()
    padding = sum(0 if (s := sum(p[2] for p in b)) & (s - 1) == 0 else capacity - s for b in packer.closed)
    assert padding < 0.03 * total
