"""Quality by a hashed n-gram log-likelihood ratio, behind fixed base rules.

Words and word pairs are hashed into ``BUCKETS`` buckets. One multinomial over the buckets
is counted from all texts (raw), one from trusted texts (target). A text's score is the
mean over its n-grams of log target - log raw, and a text is kept from ``THRESHOLD`` on.
All work is done by SQL functions; the counted table has ``BUCKETS`` rows whatever the
input, so it travels to the second pass as one literal array. Raw counts come from a plain
scan. Trusted texts are found by a merge join, the same at all sizes: the labels grow with
the corpus, so they are not broadcast, and the texts are shuffled once for it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, THRESHOLD = 10_000, -0.035
WHITE = "[\\x20\\x09-\\x0D]+"
MIN_WORDS, MOST_REPEATED = 20, 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _shift(way: str, value: Column, bits: Column) -> Column:
    return F.call_function(f"shift{way}", value, bits)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), WHITE), lambda w: w != "")


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def hashed_grams(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all words, then of all pairs of neighbouring words, from the words' hashes."""
    one = F.transform(hashes, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    pairs = F.transform(F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(hashes[i], x), F.lit(buckets)).cast("int"))
    return F.when(F.size(hashes) > 1, F.concat(one, pairs)).otherwise(one)


def repeated_words(hashes: Column, width: int = 8) -> Column:
    """How many words lie in ``width``-word windows that occur more than once, from the words' hashes."""
    none = F.array().cast("array<bigint>")
    at = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - width + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *(hashes[i + k] for k in range(1, width))))
    windows = F.when(F.size(hashes) >= width, at).otherwise(none)

    def covered(win: Column) -> Column:
        # hashes share a sorted array of longs with their places: high bits and low bits
        bits = F.greatest(F.lit(1), F.ceil(F.log2(F.size(win) + 1))).cast("int")
        keyed = F.transform(win, lambda x, i: _shift("left", _shift("right", x, bits), bits).bitwiseOR(i.cast("long")))
        place = lambda k: k.bitwiseAND(_shift("left", F.lit(1).cast("long"), bits) - 1).cast("int")

        def twice(s: Column) -> Column:
            same = lambda k, j: win[place(k)] == win[place(F.get(s, j))]
            hit = F.filter(s, lambda k, i: F.when(i > 0, same(k, i - 1)).otherwise(False) | F.when(i < F.size(s) - 1, same(k, i + 1)).otherwise(False))
            return F.array_sort(F.transform(hit, place))

        total = lambda p: F.aggregate(
            p,
            F.struct(F.lit(-1000).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(width), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(let(let(F.sort_array(keyed), twice), total))

    return let(windows, covered)


def base_columns(text: Column, words: Column, hashes: Column) -> dict[str, Column]:
    """The counts of the base rules. Windows of words are compared by their 64-bit hashes."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    worded = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, WHITE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(worded, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeated_words(hashes),
    }


def ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[float]:
    """log target - log raw of every bucket, with one added to each count.

    Raw counts cover all texts, target counts all texts whose id is labelled 1. Null ids
    are never trusted; repeated rows count each.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("id"))

    def counted(some: DataFrame, name: str) -> DataFrame:
        grams = some.select(F.explode(let(hashes_of(words_of(F.col("text"))), lambda h: hashed_grams(h))).alias("bucket"))
        return grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.lit(name))

    counts = {"raw": [1] * BUCKETS, "target": [1] * BUCKETS}
    for r in counted(texts, "raw").unionByName(counted(texts.join(trusted.hint("merge"), "id", "left_semi"), "target")).collect():  # at most 2 * BUCKETS rows
        counts[r.of][r.bucket] += r.n
    shift = math.log(sum(counts["raw"])) - math.log(sum(counts["target"]))
    return [math.log(t) - math.log(r) + shift for t, r in zip(counts["target"], counts["raw"], strict=True)]


def judge(docs: DataFrame, table: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept.

    A null text has no words; it and an empty one fail the base rules. Columns of these
    names are replaced; other columns stay. Repeated rows are judged alike.
    """
    llr = F.split(F.lit(",".join(f"{x:.6g}" for x in table)), ",").cast("array<double>")

    def all_of(both: Column) -> Column:
        words, hashes = both["words"], both["hashes"]
        total = let(hashed_grams(hashes, len(table)), lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(llr, b)) / F.greatest(F.size(g), F.lit(1)))
        return F.struct(*(c.alias(n) for n, c in base_columns(F.col(text_col), words, hashes).items()), total.alias("llr"))

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"]
    found = docs.drop(*names, "base_failed", "kept").withColumn("__rules", let(let(words_of(F.col(text_col)), lambda w: F.struct(w.alias("words"), hashes_of(w).alias("hashes"))), all_of))
    flat = found.select(*(c for c in found.columns if c != "__rules"), *(F.col(f"__rules.{n}").alias(n) for n in names))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return flat.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
