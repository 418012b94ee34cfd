"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a table with the columns of documents (the last one: pieces of sequences). Between stages
the table is written, so that a lost executor costs the current stage only.

Defined cases: documents without a letter are rejected by the first stage (with null and empty texts); rows with a null doc_id are linked with nothing and stay; of rows of one doc_id one
stays; a document all of whose words repeat keeps an empty text; an empty table gives an empty result; columns other than doc_id, text and n_chars pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm import language, neardup, packing, pii, substrings
from orbweave.llm.shared import discard, free_names, written

#: Documents whose language is less certain go. Two even votes in a row give 0.25, so this only drops contradictory votes.
MIN_SCORE = 0.2
SHINGLE_WORDS, SIMILARITY = 5, 80
WINDOW_WORDS = 20
#: Ids that may be broadcast.
BROADCAST_IDS = 500_000


def _with_text(docs: DataFrame, text, columns: list[str]) -> DataFrame:
    """docs with a new text, and n_chars to match."""
    out = docs.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told; an unknown label is filled in."""
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    judged = language.predict(docs, model)
    found = F.col(judged.columns[-1])
    kept = judged.where((found["lang_pred"] != "und") & (found["score"] >= MIN_SCORE))
    if "lang" in docs.columns:
        kept = kept.withColumn("lang", F.coalesce(F.col("lang"), found["lang_pred"]))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates."""
    groups = written(neardup.near_duplicates(docs, SHINGLE_WORDS, SIMILARITY), "pipeline-groups")
    gone = groups.where("NOT kept").select("doc_id").distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = groups.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.head(1):
        return kept
    rest = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    nth = free_names(docs.columns, "nth")[0]
    first = kept.join(repeated, "doc_id", "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))).where(F.col(nth) == 1).select(*docs.columns)
    return rest.unionByName(first)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that an earlier document holds."""
    null = free_names(docs.columns, "null")[0]
    marked = docs.withColumn(null, F.col("text").isNull())
    out = substrings.dedup_passages(marked, WINDOW_WORDS, keep_spacing=True, carry=[c for c in marked.columns if c != "text"])
    kept = out.select("carried.*", F.col("kept").alias("text"))
    return _with_text(kept, F.when(~F.col(null), F.col("text")), docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates."""
    out = pii.replace_pii(docs, pii.key_of(spark))
    return _with_text(out, F.col("text"), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs documents into sequences of 1024 tokens."""
    return packing.pack_table(docs)


STAGES = [
    ("language id", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        step = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        discard(docs)  # only what written() made goes
        docs = step
    return STAGES[-1][1](spark, docs, sf_dir)


#: The language models and the tokenizer can't be put in SQL; tests compare with brute force.
ORACLE_SQL = None
