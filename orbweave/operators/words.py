"""Words of posts over time: validity, times, vocabularies, interval statistics, keywords, histogram.

posts: post_id, user, created_at (timestamp or ISO text), text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ORIGIN_MICROS, WORD, age_days, distinct_words, parse_timestamp

#: A stretch of time, and about how many times of words a task works on at once.
STRETCH_MICROS, TIMES = 28 * 86_400_000_000, 1_000_000


def with_time(posts: DataFrame) -> DataFrame:
    """created_at as a timestamp; unreadable times become null."""
    if dict(posts.dtypes)["created_at"] == "string":
        return posts.withColumn("created_at", parse_timestamp(F.col("created_at")))
    return posts.withColumn("created_at", F.col("created_at").cast("timestamp"))


def valid_posts(posts: DataFrame) -> DataFrame:
    """Posts with a text and a time."""
    return posts.where((F.length("text") > 0) & F.col("created_at").isNotNull())


def newest_posts(posts: DataFrame, cap: int = 3000) -> DataFrame:
    """Each user's newest posts. Spark limits each task's rows before the shuffle, so a hot user is cut where it is read."""
    nth = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("created_at"), F.desc("post_id")))
    return posts.withColumn("nth", nth).where(F.col("nth") <= cap).drop("nth")


def post_words(posts: DataFrame) -> DataFrame:
    """post_id, user, word, age: each distinct word of each valid post."""
    return valid_posts(posts).select("post_id", "user", age_days(F.col("created_at")).alias("age"), F.explode(distinct_words(F.col("text"))).alias("word"))


def writers(posts: DataFrame) -> DataFrame:
    """user: those of post_words(). Only whether a text holds a word is asked, so that no text leaves the task that reads it; one with two ASCII characters of words side by side needs no lower case."""
    some = F.regexp_like("text", F.lit("[A-Za-z0-9_]{2}")) | F.regexp_like(F.lower("text"), F.lit(WORD))
    return posts.where((F.length("text") > 0) & some & F.col("created_at").isNotNull()).select("user").distinct()


def user_words(words: DataFrame) -> DataFrame:
    return words.select("user", "word").distinct()


def vocabulary_sizes(users: DataFrame, words: DataFrame) -> DataFrame:
    """user, n_words for every user; 0 for those without posts."""
    sizes = user_words(words).groupBy("user").agg(F.count("*").alias("n_words"))
    return users.join(sizes, "user", "left").select("user", F.coalesce("n_words", F.lit(0)).alias("n_words"))


def word_counts(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("occurrences"), F.min("age").alias("first_age"), F.max("age").alias("last_age"))


def _merge(a: Column, b: Column) -> Column:
    """Count, mean and squared deviations of two samples taken together."""
    n = a["n"] + b["n"]
    delta = b["mean"] - a["mean"]
    mean = F.when(n > 0, a["mean"] + delta * b["n"] / n).otherwise(F.lit(0.0))
    m2 = F.when(n > 0, a["m2"] + b["m2"] + delta * delta * a["n"] * b["n"] / n).otherwise(F.lit(0.0))
    return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))


def interval_spread(words: DataFrame, at_least: int = 3, stretch_days: float = 28.0, users: bool = False) -> DataFrame:
    """word, occurrences, desvio_padrao: population standard deviation of the gaps between a word's sorted times; if wanted, also users: the distinct users of the word.

    A word's times are dealt by stretches of time, so that a word in a third of all posts doesn't meet in one task. A stretch
    gives its gaps' count, mean and squared deviations with its first and last time; a word's stretches (as many as the time span has, at
    most) are merged in order, and the gap between two stretches is one more sample.
    """
    times = words.select("word", "age", F.floor(F.col("age") / stretch_days).alias("stretch"), *["user"] * users)
    gap = F.col("age") - F.lag("age").over(Window.partitionBy("word", "stretch").orderBy("age"))
    parts = times.withColumn("gap", gap).groupBy("word", "stretch").agg(
        F.count("gap").alias("n"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop("gap") * F.count("gap"), F.lit(0.0)).alias("m2"), F.min("age").alias("first"), F.max("age").alias("last"), F.count("*").alias("times"), *[F.collect_set("user").alias("users")] * users)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"), F.lit(None).cast("double").alias("last"))

    def step(a: Column, p: Column) -> Column:
        between = F.struct(F.when(a["last"].isNull(), 0).otherwise(1).cast("long").alias("n"), F.coalesce(p["first"] - a["last"], F.lit(0.0)).alias("mean"), F.lit(0.0).alias("m2"))
        out = _merge(_merge(a, between), p)
        return F.struct(out["n"].alias("n"), out["mean"].alias("mean"), out["m2"].alias("m2"), p["last"].alias("last"))

    whole = parts.groupBy("word").agg(F.sum("times").alias("occurrences"), F.array_sort(F.collect_list(F.struct("stretch", "n", "mean", "m2", "first", "last"))).alias("parts"), *[F.collect_list("users").alias("users")] * users).where(F.col("occurrences") >= at_least)
    total = F.aggregate("parts", start, step)
    more = [F.array_distinct(F.flatten("users")).alias("users")] * users
    return whole.select("word", "occurrences", total.alias("t"), *more).select("word", "occurrences", F.sqrt(F.when(F.col("t.n") > 0, F.col("t.m2") / F.col("t.n"))).alias("desvio_padrao"), *["users"] * users)


def _low_bytes(values: np.ndarray, width: int) -> np.ndarray:
    """The low bytes of each number, a row each."""
    return np.ascontiguousarray(values.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :width]


def _numbers(packed: np.ndarray, width: int) -> np.ndarray:
    """The numbers (with a sign) of which _low_bytes() are given."""
    out = np.zeros((len(packed) // width, 8), np.uint8)
    out[:, 8 - width :] = packed.reshape(-1, width)
    return out.view("<i8").reshape(-1) >> (64 - 8 * width)


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data).reshape(-1))])


def _content(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of binaries (nulls have none), and the size of each."""
    column = column.fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, np.diff(ends)


def keyword_users(posts: DataFrame, at_least: int = 3) -> DataFrame:
    """interval_spread(post_words(posts), at_least, users=True).

    Here a word leaves the task that reads its posts once for a stretch of time, with the times (6 bytes each) and users (as few bytes as the task's users need) of all its posts, not as a row a
    post. What stands for a word is sorted by stretch, so that a task holds one stretch of a word in a third of all posts, and its distinct users.
    """
    kind = posts.schema["user"].dataType
    whole = kind.typeName() in ("byte", "short", "integer", "long")
    user, sent = kind.simpleString(), "binary" if whole else f"array<{kind.simpleString()}>"
    lists = valid_posts(posts).select(F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), "user", distinct_words(F.col("text")).alias("words"))

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        """word, stretch, at, who (null if the posts have no user) of posts all or none of which have a user."""
        words = batch["words"].flatten().dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False)
        post = np.repeat(np.arange(batch.num_rows, dtype=np.int32), pc.list_value_length(batch["words"]).to_numpy(zero_copy_only=False))
        stretch, at = np.divmod(batch["at"].to_numpy(zero_copy_only=False) - ORIGIN_MICROS, STRETCH_MICROS)
        order = np.argsort(code, kind="stable") if len(np.unique(stretch)) < 2 else np.lexsort((stretch[post], code))
        code, post = code[order], post[order]
        start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (stretch[post][1:] != stretch[post][:-1])]) if len(code) else np.zeros(0, np.int64)
        many = np.diff(np.r_[start, len(code)])
        if batch["user"].null_count:
            who = pa.nulls(len(start), pa.binary() if whole else pa.list_(batch["user"].type))
        elif whole:
            users = batch["user"].to_numpy(zero_copy_only=False).astype(np.int64)
            width = next(w for w in range(1, 9) if w == 8 or (np.abs(users + (users < 0)) < 1 << (8 * w - 1)).all())
            who = _binaries(_low_bytes(users, width)[post], many * width)
        else:
            who = pa.ListArray.from_arrays(pa.array(np.r_[start, len(code)], pa.int32()), batch["user"].take(pa.array(post)))
        return pa.record_batch({"word": words.dictionary.take(pa.array(code[start])), "stretch": pa.array(stretch[post[start]]), "at": _binaries(_low_bytes(at, 6)[post], many * 6), "who": who})

    def pack(batches):
        for batch in batches:
            for part in (batch.filter(pc.is_valid(batch["user"])), batch.filter(pc.is_null(batch["user"]))):
                if part.num_rows and len(part["words"].flatten()):
                    yield packed(part)

    def measured(table: pa.Table) -> dict:
        """Of whole stretches, sorted: each word with its gaps' count, mean and squared deviations, first and last age, times and distinct users."""
        words, stretch, who = table["word"].combine_chunks(), table["stretch"].to_numpy(), table["who"].combine_chunks()
        data, sizes = _content(table["at"].combine_chunks())
        start = np.flatnonzero(np.r_[True, pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False).astype(bool)])
        row = np.repeat(np.arange(len(words)), sizes // 6)
        word = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(words)]))[row]
        at = _numbers(data, 6) + stretch[row] * STRETCH_MICROS
        if whole:
            data, have = _content(who)
            width = have // (sizes // 6)
            users = np.zeros(len(at), np.int64)
            for w in np.unique(width[width > 0]):
                users[(width == w)[row]] = _numbers(data[np.repeat(width == w, have)], int(w))
            users = pa.array(users)
        else:
            users = pa.nulls(len(at), who.type.value_type) if who.null_count == len(who) else pa.concat_arrays([x.values if x.is_valid else pa.nulls(int(n), who.type.value_type) for x, n in zip(who, sizes // 6)])
        codes = users.dictionary_encode()
        known = np.repeat(pc.is_valid(who).to_numpy(zero_copy_only=False).astype(bool), sizes // 6)
        pairs = word[known] * len(codes.dictionary) + codes.indices.fill_null(0).to_numpy(zero_copy_only=False)[known]
        pairs = np.unique(pairs)
        owner, member = np.divmod(pairs, max(1, len(codes.dictionary)))
        age = (at / 1e6 / 86400)[np.lexsort((at, word))]
        times = np.bincount(word, minlength=len(start))
        first = np.r_[0, np.cumsum(times)[:-1]]
        gap, of = np.diff(age), word[1:]
        inside = of == word[:-1]
        gap, of, n = gap[inside], of[inside], times - 1
        mean = np.bincount(of, gap, len(start)) / np.maximum(n, 1)
        m2 = np.bincount(of, (gap - mean[of]) ** 2, len(start))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(start) + 1)), pa.int32()), codes.dictionary.take(pa.array(member)))
        return {"word": words.take(pa.array(start)), "n": n, "mean": mean, "m2": m2, "first": age[first], "last": age[first + times - 1], "times": times, "users": lists}

    def rows(m: dict, some: slice) -> pa.RecordBatch:
        n, m2, times = (m[c][some] for c in ("n", "m2", "times"))
        spread = np.sqrt(m2 / np.maximum(n, 1))
        out = pa.record_batch({"word": m["word"][some], "occurrences": pa.array(times, pa.int64()), "desvio_padrao": pa.array(spread, mask=n == 0), "users": m["users"][some]})
        return out.filter(pa.array(times >= at_least))

    def merged(a: dict, b: dict) -> dict:
        """Two stretches or more of one word."""
        n = int(a["n"][0] + b["n"][0] + 1)
        means, sizes = np.array([a["mean"][0], b["mean"][0], b["first"][0] - a["last"][0]]), np.array([a["n"][0], b["n"][0], 1])
        mean = (means * sizes).sum() / n
        m2 = a["m2"][0] + b["m2"][0] + (sizes * (means - mean) ** 2).sum()
        users = pc.unique(pa.concat_arrays([a["users"].flatten(), b["users"].flatten()]))
        return a | {"n": np.array([n]), "mean": np.array([mean]), "m2": np.array([m2]), "last": b["last"], "times": a["times"] + b["times"], "users": pa.ListArray.from_arrays(pa.array([0, len(users)], pa.int32()), users)}

    def spread(batches):
        """Of a task's rows, sorted by word and stretch."""
        waiting, size, held = [], 0, None

        def work(table):
            nonlocal held
            m = measured(table)
            one = lambda k: {c: v[k : k + 1] if k >= 0 else v[len(v) - 1 :] for c, v in m.items()}
            at = 0
            if held is not None and held["word"][0] == m["word"][0]:
                held, at = merged(held, one(0)), 1
            if at < len(m["word"]):
                if held is not None:
                    yield rows(held, slice(0, 1))
                held = one(-1)
                yield rows(m, slice(at, len(m["word"]) - 1))

        for batch in batches:
            waiting.append(batch)
            size += batch["at"].nbytes // 6
            if size > TIMES:
                table = pa.Table.from_batches(waiting)
                words, stretch = table["word"].combine_chunks(), table["stretch"].combine_chunks()
                other = pc.or_(pc.not_equal(words, words[len(words) - 1]), pc.not_equal(stretch, stretch[len(words) - 1])).to_numpy(zero_copy_only=False)
                cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
                if cut:
                    yield from work(table[:cut])
                    waiting = table[cut:].to_batches()
                    size = sum(b["at"].nbytes // 6 for b in waiting)
        if waiting:
            yield from work(pa.Table.from_batches(waiting))
        if held is not None:
            yield rows(held, slice(0, 1))

    found = lists.mapInArrow(pack, f"word string, stretch long, at binary, who {sent}").repartition("word").sortWithinPartitions("word", "stretch")
    return found.mapInArrow(spread, f"word string, occurrences long, desvio_padrao double, users array<{user}>")


def filter_keywords(stats: DataFrame, least: float = 0.0, most: float = 10_000.0, occurrences: int = 1) -> DataFrame:
    """Words whose spread and frequency lie in (closed) bounds."""
    return stats.where(F.col("desvio_padrao").between(least, most) & (F.col("occurrences") >= occurrences))


def with_source(keywords: DataFrame, source: str) -> DataFrame:
    return keywords.withColumn("source_gexf", F.lit(source))


#: Histogram: 499 bins whose edges are spaced evenly in the logarithm from 10**-1 to 10**4.
BINS, LOW, HIGH = 499, -1.0, 4.0


def spread_histogram(stats: DataFrame) -> DataFrame:
    """bin, center, n, p: share of the words within the range; the last bin is closed; empty bins are left out."""
    x, width = F.col("desvio_padrao"), (HIGH - LOW) / BINS
    inside = stats.where((x >= 10**LOW) & (x <= 10**HIGH)).select(F.least(F.floor((F.log10(x) - LOW) / width), F.lit(BINS - 1)).cast("int").alias("bin"))
    counts = inside.groupBy("bin").agg(F.count("*").alias("n"))
    # One row for each bin at most, so the total is taken over a bounded window.
    center = F.pow(F.lit(10.0), F.lit(LOW) + (F.col("bin") + 0.5) * width)
    return counts.select("bin", center.alias("center"), "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))
