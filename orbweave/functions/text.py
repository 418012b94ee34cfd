"""Column functions for post texts and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The origin of ages (2023-02-17T00:00Z in microseconds), and a word: two or more letters, digits or underscores.
ORIGIN_MICROS = 1_676_592_000_000_000
WORD = r"[\p{L}\p{N}_]{2,}"


def parse_timestamp(text: Column) -> Column:
    """An ISO-8601 time with an offset; null where it can't be read or has none. Digits beyond microseconds are cut."""
    zoned = F.regexp_like(text, F.lit(r"[T ]\d{2}:\d{2}.*(?:Z|[+-]\d{2}:?\d{2})$"))
    return F.when(zoned, F.try_to_timestamp(F.regexp_replace(text, r"(\.\d{6})\d+", "$1")))


def age_days(ts: Column) -> Column:
    """Days since the origin; negative before it."""
    return (F.unix_micros(ts.cast("timestamp")) - F.lit(ORIGIN_MICROS)) / F.lit(1e6) / F.lit(86400)


def distinct_words(text: Column) -> Column:
    """Distinct lower-case words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))
