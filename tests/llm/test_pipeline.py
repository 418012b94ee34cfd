import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_neardup import brute as brute_groups
from test_packing import check as check_pieces
from test_substrings import brute as brute_passages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, id string, kept boolean"


def _stages(spark, docs, tmp, sf="unused"):
    out = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp}/{i}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_every_stage_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, near, cut, clean, packed = _stages(spark, docs, tmp_path)
    assert all(d.columns == docs.columns for d in (first, near, cut, clean))
    text = lambda d: {r["doc_id"]: r["text"] for r in d.collect()}
    before, a, b, c, d = map(text, (docs, first, near, cut, clean))
    assert set(a) == {i for i, t in before.items() if t and re.search(r"[^\W\d_]", t)} and all(a[i] == before[i] for i in a)
    groups = brute_groups(list(a.items()), 5)
    assert set(b) == {i for i in a if groups[i][2]} and all(a[i] == b[i] for i in b)
    rows = sorted(b.items())
    for (i, t), (_, removed, kept) in zip(rows, brute_passages(rows, 20), strict=True):
        assert " ".join(c[i].split()) == kept and (removed or c[i] == t)
    assert set(c) == set(d)
    assert not any(re.search(r"@mail\d|555-\d{4}", d[i]) and d[i] == c[i] for i in d)
    assert all(d[i] == c[i] for i in c if not re.search(r"[\d@]|password|token", c[i]))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_pieces(packed.collect(), {i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in d.items()})
    assert {r["doc_id"]: r["n_chars"] for r in clean.collect()} == {i: len(t) for i, t in d.items()}


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "12 %"), (4, words), (4, words), (None, words), (None, words), (5, words + " x"), (6, "mail a.b@c.de " + "long text " * 20_000)]
    docs = spark.createDataFrame([(i, t, "en" if i != 5 else None, None, None, 1, "z", None) for i, t in rows], SCHEMA)
    first, near, cut, clean, packed = _stages(spark, docs, tmp_path)
    assert sorted((r["doc_id"] or 0) for r in first.collect()) == [0, 0, 4, 4, 5, 6]
    assert sorted((r["doc_id"] or 0) for r in near.collect()) == [0, 0, 4, 6]
    assert sorted((r["doc_id"] or 0, r["text"] == "") for r in cut.collect()) == [(0, False), (0, True), (4, True), (6, False)]
    assert "a.b@c.de" not in " ".join(r["text"] for r in clean.collect()) and clean.columns == docs.columns
    assert np.sum([r["length"] for r in packed.collect()]) > 0
    (tmp_path / "none").mkdir()
    assert _stages(spark, docs.limit(0), tmp_path / "none")[-1].collect() == []


def test_run_equals_the_stages(spark, sf, tmp_path):
    want = _stages(spark, spark.read.parquet(f"{sf}/documents.parquet"), tmp_path, sf)[-1]
    key = lambda d: sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in d.select("doc_id", "start", "ids_crc32").collect())
    tokens = lambda d: {(r["doc_id"], r["doc_tokens"]) for r in d.collect()}
    got = corpus_pipeline.run(spark, sf)
    assert tokens(got) == tokens(want) and sum(1 for _ in key(got)) > 0
