"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(c: Column) -> Column:
    """Lower case, trimmed, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def anls(prediction: Column, references: Column, threshold: float = 0.5) -> Column:
    """Best normalised similarity over the references; 0 where the distance reaches the threshold.

    The distance is that of the normalised strings over the longer of the raw ones.
    """

    def one(ref: Column) -> Column:
        size = F.greatest(F.length(prediction), F.length(ref))
        return F.coalesce(F.try_divide(F.levenshtein(plain(prediction), plain(ref)).cast("double"), size.cast("double")), F.lit(0.0))

    least = F.array_min(F.transform(references, one))
    return F.when(least < threshold, 1 - least).otherwise(0.0)


def number(c: Column) -> Column:
    """A string as a double; a trailing percent sign divides by 100; null if it is no number."""
    return F.when(c.endswith("%"), F.regexp_replace(c, "%$", "").try_cast("double") / 100.0).otherwise(c.try_cast("double"))


def relaxed_match(target: Column, prediction: Column, tolerance: float = 0.05) -> Column:
    """Numbers within a relative tolerance, else equal strings in lower case. A target of 0 is compared as a string."""
    t, p = number(target), number(prediction)
    near = F.abs(p - t) <= tolerance * F.abs(t)
    return F.when(p.isNotNull() & t.isNotNull() & (t != 0), near).otherwise(F.lower(target) == F.lower(prediction))


def soft_accuracy(prediction: Column, answers: Column) -> Column:
    """Mean over the answers of min(1, matches among the answers that differ from it / 3)."""
    each = F.transform(answers, lambda a: F.least(F.lit(1.0), F.size(F.filter(answers, lambda b: (b != a) & (b == prediction))) / 3.0))
    return F.coalesce(F.try_divide(F.aggregate(each, F.lit(0.0), lambda x, y: x + y), F.size(answers).cast("double")), F.lit(0.0))


def set_f1(prediction: Column, reference: Column) -> Column:
    """F1 of the distinct word-or-symbol tokens."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"), F.lit(0)))
    p, r = tokens(prediction), tokens(reference)
    both = F.size(F.array_intersect(p, r))
    return F.coalesce(F.try_divide(2.0 * both, (F.size(p) + F.size(r)).cast("double")), F.lit(0.0))


def qa_words(c: Column) -> Column:
    """Words without punctuation and English articles, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", ""), r"\b(a|an|the)\b", " ")
    return F.filter(F.split(bare, r"\s+"), lambda w: w != "")


def qa_f1(prediction: Column, reference: Column) -> Column:
    """F1 of the word multisets; with an empty side, whether both are."""
    # words with their number among equal ones; a variable of a lambda keeps the arrays from being made anew for each word
    numbered = lambda a: F.transform(a, lambda w, k: F.concat_ws(" ", w, k - F.array_position(a, w)))

    def one(x: Column) -> Column:
        p, r = x["p"], x["r"]
        both = F.size(F.array_intersect(numbered(p), numbered(r)))
        return F.when((F.size(p) == 0) | (F.size(r) == 0), (F.size(p) == F.size(r)).cast("double")).otherwise(2.0 * both / (F.size(p) + F.size(r)))

    sides = F.struct(F.sort_array(qa_words(prediction)).alias("p"), F.sort_array(qa_words(reference)).alias("r"))
    return F.transform(F.array(sides), one)[0]


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two [x1, y1, x2, y2] arrays; 0 without a union."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.coalesce(F.try_divide(width * height, area(a) + area(b) - width * height), F.lit(0.0))


def centre_inside(a: Column, b: Column) -> Column:
    """Whether the centre of box ``a`` lies in box ``b``."""
    x, y = (a[0] + a[2]) / 2, (a[1] + a[3]) / 2
    return (x >= b[0]) & (x <= b[2]) & (y >= b[1]) & (y <= b[3])


def parse_box(c: Column) -> Column:
    """The first [f, f, f, f] of a text as an array of doubles, zeros without one."""
    number_ = r"\s*(-?\d+(?:\.\d+)?)\s*"
    pattern = r"\[" + ",".join([number_] * 4) + r"\]"
    return F.array(*(F.coalesce(F.regexp_extract(c, pattern, k).try_cast("double"), F.lit(0.0)) for k in range(1, 5)))


# Answer prefixes that are cut before a letter is looked for; two of them are run together, as the scores expect.
PREFIXES = ("The best answer is", "The correct answer is", "The answer is", "The answer", "The best option isThe correct option is", "Best answer:Best option:")


def choice_letter(c: Column) -> Column:
    """The first letter A to D after the prefixes are cut; empty if a text of more than ten words has none before."""
    bare = F.trim(c)
    for prefix in PREFIXES:
        bare = F.replace(bare, F.lit(prefix), F.lit(""))
    long_ = (F.size(F.split(bare, " ")) > 10) & ~bare.rlike("[ABCD]")
    return F.when(long_, "").otherwise(F.regexp_extract(bare, "[ABCD]", 0))


def yes_no(c: Column) -> Column:
    """yes, no or other: the whole answer, or its first four characters."""
    low = F.lower(F.trim(c))
    head = F.substring(low, 1, 4)
    return F.when(low.isin("yes", "no"), low).when(head.contains("yes"), "yes").when(head.contains("no"), "no").otherwise("other")


def first_of(c: Column, first: str, second: str) -> Column:
    """Which of two words stands first in the text (1 for ``first``, 0 for ``second``, -1 for neither)."""
    a, b = F.regexp_instr(F.lower(c), F.lit(rf"\b{first}\b")), F.regexp_instr(F.lower(c), F.lit(rf"\b{second}\b"))
    return F.when((a == 0) & (b == 0), -1).when((a > 0) & ((b == 0) | (a < b)), 1).otherwise(0)


def srt_seconds(c: Column) -> Column:
    """HH:MM:SS,ms as seconds."""
    part = F.split(F.replace(c, F.lit(","), F.lit(".")), ":")
    return part[0].cast("double") * 3600 + part[1].cast("double") * 60 + part[2].cast("double")


def polarity(c: Column, positive: list[str], negative: list[str], default: str = "unclear") -> Column:
    """pos or neg by the number of distinct key words; words of both lists are dropped; ties give ``default``."""
    clear = lambda own, other: [w for w in own if w not in other]
    count = lambda words: sum((F.lower(c).contains(w).cast("int") for w in words), F.lit(0))
    p, n = count(clear(positive, negative)), count(clear(negative, positive))
    return F.when(p > n, "pos").when(n > p, "neg").otherwise(default)


def verdict(c: Column) -> Column:
    """1 for Correct, 0 for Incorrect, null for neither, by prefix and then by content."""
    return (
        F.when(c.startswith("Correct"), 1).when(c.startswith("Incorrect"), 0).when(c.contains("Correct") & ~c.contains("Incorrect"), 1).when(c.contains("Incorrect") & ~c.contains("Correct"), 0)
    )


def json_valid(c: Column) -> Column:
    """Whether a text is one JSON value and nothing after it."""
    alone = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull()
    return F.coalesce(alone & F.try_parse_json(F.concat(F.lit('{"x":'), c, F.lit("}"))).isNotNull(), F.lit(False))
