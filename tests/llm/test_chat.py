import hashlib
import time

import pytest
from pyspark.sql import functions as F

from orbweave.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns int"


def _format(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    out = chat.format_conversations(df).withColumn("back", chat.read_back(F.col("formatted")))
    return {r["conv_id"]: r for r in out.collect()}


def test_merges_neighbours_and_reads_back(spark):
    rows = [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 3, "assistant", "d\\<|end|>"), (1, 4, None, None)]
    r = _format(spark, rows)[1]
    assert [(b["role"], len(b["texts"])) for b in r["blocks"]] == [("user", 2), ("assistant", 2), ("", 1)]
    assert [(t["role"], t["text"]) for t in r["back"]] == [("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "d\\<|end|>"), ("", "")]
    assert r["formatted"].startswith("<|start|>user<|message|>a<|turn|>b<|end|><|start|>assistant<|message|>c<|turn|>")
    assert [r["formatted"][s["begin"]:s["begin"] + s["length"]] for s in r["loss_spans"]] == ["c", "d\\\\<\\|end|>"]


@pytest.mark.parametrize("text", ["", "\\", "\\\\<|end|>", "<", "<\\|end|>", "</s>[INST] ok [/INST]", "<<SYS>>x<</SYS>>", "a\nb", "[[INST]", "é<|start|>ß", "<|", "|>" * 3, "\U0001f600<s>"])
def test_any_text_survives(spark, text):
    r = _format(spark, [(5, 0, text, text), (5, 1, "assistant", text), (5, 1, "assistant", text)])[5]
    roles = [text] + ["assistant"] * 2
    assert [(t["role"], t["text"]) for t in r["back"]] == [(x, text) for x in roles]
    for s in r["loss_spans"]:
        inside = r["formatted"][s["begin"]:s["begin"] + s["length"]]
        assert "<|end|>" not in inside and "</s>" not in inside and "[INST]" not in inside


def test_null_id_long_text_and_empty_table(spark):
    out = _format(spark, [(None, None, "assistant", "x" * 300_000), (None, 1, "user", "y")])
    assert [t["text"][:1] for t in out[None]["back"]] == ["x", "y"] and out[None]["loss_spans"][0]["length"] == 300_000
    assert _format(spark, []) == {}


def test_query_has_the_extra_conversation(spark, sf):
    r = {x["conv_id"]: x for x in chat.op6_chat_format(spark, sf).collect()}[-7]
    said = "</s>[INST] ok [/INST]"
    assert r["n_turns"] == 2 and r["loss_chars"] == len(said)
    assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_text_comes_from_the_merge_and_long_conversations_end_soon(spark):
    plan = chat.op6_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "texts" in plan
    n = 50_000
    rows = [(1, i, "user" if i % 700 else "assistant", f"t{i}") for i in range(n)] + [(2, i, ("user", "assistant")[i % 2], f"</s>{i}") for i in range(n)]
    began = time.time()
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    assert time.time() - began < 60
    for r in got:
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, text) for c, _, role, text in rows if c == r["conv_id"]]
        loss = [r["formatted"][s["begin"]:s["begin"] + s["length"]].replace("<\\", "<") for s in r["loss_spans"]]
        assert loss == [text for c, _, role, text in rows if c == r["conv_id"] and role == "assistant"]
