"""Operator 6: chat formatting with Spark expressions only.

Turns of a conversation are sorted as collected structs, neighbours of one role merge to blocks by an
array aggregation (chunk by chunk, so that long conversations are not copied once a turn), and the blocks are concatenated with marks:

    <|start|>role<|message|>text<|turn|>text<|end|>

A merged block keeps <|turn|> between its turns, so the turns can be read back. Control strings
(ours and those of other common templates) that occur inside a role or text are escaped by a
backslash after their first character, and a backslash is doubled; ``unescape`` is the exact inverse.

Defined cases: a null role or text counts as empty; rows of one turn number are ordered by role, then
text; repeated rows stay; a null turn number sorts first; a null conv_id is a conversation of its own;
an empty table gives an empty result. A conversation becomes one row, so its turns meet in one task
by the nature of the result; conversations spread evenly over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, MESSAGE, TURN, END = "<|start|>", "<|message|>", "<|turn|>", "<|end|>"
#: A control string is one of these first characters followed by one of these rests.
ANGLE = r"\|[A-Za-z_]+\|>|/?s>|</?SYS>>"
BRACKET = r"/?[A-Z_]+\]"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, rf"(<)(?={ANGLE})|(\[)(?={BRACKET})", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


#: Turns that are merged, and lengths that are summed, at a time: an aggregation copies what it has gathered.
AT_A_TIME = 256

BLOCKS = "array<struct<role: string, texts: array<string>>>"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def _chunks(items: Column) -> Column:
    """array<array>: the items, AT_A_TIME in each."""
    return F.transform(F.sequence(F.lit(0), ((F.size(items) - 1) / AT_A_TIME).cast("int")), lambda k: F.slice(items, k * AT_A_TIME + 1, F.lit(AT_A_TIME)))


def _appended(blocks: Column, more: Column) -> Column:
    """Two lists of blocks as one; the last of the first and the first of the second merge if they have one role."""
    last, first = F.element_at(blocks, -1), F.element_at(more, 1)
    one = F.struct(last["role"].alias("role"), F.concat(last["texts"], first["texts"]).alias("texts"))
    merged = F.concat(F.slice(blocks, F.lit(1), F.size(blocks) - 1), F.array(one), F.slice(more, F.lit(2), F.size(more)))
    return F.when(F.size(blocks) == 0, more).when(last["role"] == first["role"], merged).otherwise(F.concat(blocks, more))


def merged_blocks(turns: Column) -> Column:
    """BLOCKS of array<struct<..., role, text>>: neighbours of one role merged by aggregation, first within chunks, then the chunks."""
    none = F.expr(f"CAST(array() AS {BLOCKS})")
    alone = lambda t: F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")))
    within = F.transform(_chunks(turns), lambda chunk: F.aggregate(chunk, none, lambda blocks, t: _appended(blocks, alone(t))))
    return F.aggregate(within, none, _appended)


def _begins(lengths: Column) -> Column:
    """Sum of the lengths before each."""
    zero = F.lit(0).cast("long")
    starts = lambda chunks: F.aggregate(chunks, F.array(zero), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + F.aggregate(c, zero, lambda s, n: s + n))))
    inner = lambda chunk, at: F.slice(F.aggregate(chunk, F.array(at), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n))), F.lit(1), F.size(chunk))
    return _let(_chunks(lengths), lambda chunks: F.flatten(F.zip_with(chunks, F.slice(starts(chunks), F.lit(1), F.size(chunks)), inner)))


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, blocks array<struct<role, texts>>, loss_spans array<struct<begin, length>>.

    turns: conv_id, turn, role, text; other columns are ignored. A loss span gives the code points of one
    escaped text of a loss role in ``formatted``; marks and roles lie outside all spans. Text and spans are made from the merged blocks.
    """
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    merged = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")).select("conv_id", merged_blocks(F.col("turns")).alias("blocks"))

    def pieces(b: Column) -> Column:
        """The texts of a block, each with what stands before and after it."""
        front = F.concat(F.lit(START), escape(b["role"]), F.lit(MESSAGE))
        return F.transform(b["texts"], lambda t, i: F.struct(
            F.when(i == 0, front).otherwise(F.lit(TURN)).alias("before"), escape(t).alias("text"), F.when(i == F.size(b["texts"]) - 1, F.lit(END)).otherwise(F.lit("")).alias("after"), b["role"].isin(*loss_roles).alias("loss")))

    cut = merged.withColumn("pieces", F.flatten(F.transform("blocks", pieces)))
    lengths = F.transform("pieces", lambda p: (F.length(p["before"]) + F.length(p["text"]) + F.length(p["after"])).cast("long"))
    placed = F.zip_with("pieces", _begins(lengths), lambda p, at: F.struct(p["loss"].alias("loss"), (at + F.length(p["before"])).alias("begin"), F.length(p["text"]).cast("long").alias("length")))
    return cut.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "").alias("formatted"),
        "blocks",
        F.transform(F.filter(placed, lambda p: p["loss"]), lambda p: F.struct(p["begin"].alias("begin"), p["length"].alias("length"))).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted text holds, in order."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda b: b != "")
    blocks = F.transform(blocks, lambda b: F.split(F.substring(b, F.lit(len(START) + 1), F.length(b)), r"<\|message\|>", 2))
    return F.flatten(F.transform(blocks, lambda b: F.transform(F.split(b[1], r"<\|turn\|>", -1), lambda t: F.struct(unescape(b[0]).alias("role"), unescape(t).alias("text")))))


#: Contract: one more conversation, whose texts hold control strings of another template.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    out = format_conversations(turns.unionByName(extra)).withColumn("turns", read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", (s["begin"] + 1).cast("int"), s["length"].cast("int")))), "")
    return out.withColumn("loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, lead(role) OVER w AS after,
    length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\|[A-Za-z_]+\|>|/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?[A-Z_]+\])', '[\\\1', 'g')) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN before IS DISTINCT FROM role THEN 20 + length(role) ELSE 8 END + CASE WHEN after IS DISTINCT FROM role THEN 7 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
