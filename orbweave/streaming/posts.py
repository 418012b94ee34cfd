"""Posts as a stream: repeats dropped within a watermark, words counted in windows of time.

Additions beyond the batch operators; state is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import distinct_words


def without_repeats(posts: DataFrame, late: str = "1 day") -> DataFrame:
    """Each post once. posts: post_id, user, created_at (timestamp), text."""
    return posts.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["post_id"])


def words_by_window(posts: DataFrame, width: str = "7 days", late: str | None = "1 day") -> DataFrame:
    """window_start, word, occurrences. late: None if the stream has its watermark already."""
    words = (posts.withWatermark("created_at", late) if late else posts).select("created_at", F.explode(distinct_words(F.col("text"))).alias("word"))
    return words.groupBy(F.window("created_at", width), "word").agg(F.count("*").alias("occurrences")).select(F.col("window.start").alias("window_start"), "word", "occurrences")
