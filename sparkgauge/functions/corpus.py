"""Metrics of generated text that need more than one expression: n-grams, edits, fields, parses."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgauge.functions.text import json_valid


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` words, joined by blanks."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def clipped(a: Column, b: Column) -> Column:
    """How many members of multiset ``a`` are matched in ``b``."""
    count = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    return F.aggregate(F.transform(F.array_distinct(a), lambda v: F.least(count(a, v), count(b, v))), F.lit(0), lambda s, x: s + x)


def bleu(df: DataFrame, prediction: str, reference: str, most: int = 4) -> DataFrame:
    """Corpus BLEU of one reference each: clipped counts are summed over rows, then combined."""
    p, r = F.split(prediction, r"\s+"), F.split(reference, r"\s+")
    parts = [F.size(p).cast("long").alias("lp"), F.size(r).cast("long").alias("lr")]
    for n in range(1, most + 1):
        parts += [clipped(ngrams(p, n), ngrams(r, n)).cast("long").alias(f"m{n}"), F.greatest(F.size(p) - n + 1, F.lit(0)).cast("long").alias(f"t{n}")]
    total = df.select(*parts).agg(*(F.sum(c).alias(c) for c in ("lp", "lr", *(f"{k}{n}" for n in range(1, most + 1) for k in "mt"))))
    logs = sum((F.log(F.try_divide(F.col(f"m{n}").cast("double"), F.col(f"t{n}").cast("double"))) for n in range(1, most + 1)), F.lit(0.0)) / most
    brief = F.least(F.lit(0.0), 1 - F.try_divide(F.col("lr").cast("double"), F.col("lp").cast("double")))
    return total.select((100 * F.exp(logs + brief)).alias("bleu"))


#: Characters of the pairs whose n-grams are counted together; a longer pair stands alone.
GRAM_CHARS = 1 << 17


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, number of each text's)."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) for t in texts], np.int64)


def gram_counts(predictions: list[str], references: list[str], most: int) -> list[tuple[int, int, int]]:
    """(matched, predicted, wanted) character n-grams of each order, clipped in each pair and summed over the pairs.

    An n-gram is a number: that of its first n - 1 characters and its last one as digits. With the
    pair before and the side behind it, one sort brings equal ones together.
    """
    (a, left), (b, right) = _points(predictions), _points(references)
    n = np.concatenate([left, right])
    ends = np.cumsum(n)
    letters, chars = np.unique(np.concatenate([a, b]), return_inverse=True)
    chars = chars.astype(np.int64)
    row = np.repeat(np.tile(np.arange(len(left)), 2), n) * 2 + np.repeat(np.repeat([0, 1], len(left)), n)  # pair, side
    rest = np.repeat(ends, n) - np.arange(len(chars))  # characters from here to the end of the text
    at, gram, bound, out = np.arange(len(chars)), np.zeros(len(chars), np.int64), 1, []
    for k in range(most):
        ok = rest[at] > k
        at, gram = at[ok], gram[ok]
        if bound * max(len(letters), 1) * 2 * max(len(left), 1) >= 1 << 62:
            found, gram = np.unique(gram, return_inverse=True)
            bound = max(len(found), 1)
        gram = gram * len(letters) + chars[at + k]
        bound *= max(len(letters), 1)
        key = np.sort(((row[at] >> 1) * bound + gram) * 2 + (row[at] & 1))
        side, first = key & 1, np.flatnonzero(np.diff(key >> 1, prepend=-1))
        wanted = np.add.reduceat(side, first) if len(first) else side
        counts = np.diff(first, append=len(key))
        out.append((int(np.minimum(wanted, counts - wanted).sum()), int(len(key) - side.sum()), int(side.sum())))
    return out


def chrf(df: DataFrame, prediction: str, reference: str, most: int = 6, beta: float = 2.0) -> DataFrame:
    """Corpus chrF: mean over character n-gram orders of F-beta of the summed counts."""
    names = [f"{k}{n}" for n in range(1, most + 1) for k in "mpr"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [[x or "" for x in c.to_pylist()] for c in batch.columns]
            low, size = 0, 0
            for high in range(1, batch.num_rows + 1):
                size += len(pairs[0][high - 1]) + len(pairs[1][high - 1])
                if size >= GRAM_CHARS or high == batch.num_rows:
                    found = gram_counts(pairs[0][low:high], pairs[1][low:high], most)
                    yield pa.record_batch([pa.array([x], pa.int64()) for counts in found for x in counts], names=names)
                    low, size = high, 0

    plain = lambda c, name: F.regexp_replace(c, r"\s", "").alias(name)
    counts = df.select(plain(prediction, "p"), plain(reference, "r")).mapInArrow(run, ", ".join(f"{x} long" for x in names))
    total = counts.agg(*(F.sum(x).alias(x) for x in names))
    d = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    mean = lambda k: sum((d(f"m{n}", f"{k}{n}") for n in range(1, most + 1)), F.lit(0.0)) / most
    return total.select((100 * F.coalesce(F.try_divide((1 + beta**2) * mean("p") * mean("r"), beta**2 * mean("p") + mean("r")), F.lit(0.0))).alias("chrf"))


def edit_distance(a: list, b: list) -> int:
    """Token edit distance, row by row."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@F.pandas_udf(_longs("distance", "length"))
def word_errors(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Token edit distance and reference length of each row."""
    pairs = [(str(p or "").split(), str(r or "").split()) for p, r in zip(prediction, reference, strict=True)]
    return pd.DataFrame({"distance": [edit_distance(p, r) for p, r in pairs], "length": [len(r) for _, r in pairs]})


@F.pandas_udf(T.DoubleType())
def rouge_l(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of words."""
    out = []
    for p, r in zip(prediction, reference, strict=True):
        a, b = str(p or "").split(), str(r or "").split()
        n = common_length(a, b)
        out.append(2 * n / (len(a) + len(b)) if n else 0.0)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def best_ngram_ratio(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """The best similarity of the reference with a run of as many words of the prediction."""
    out = []
    for p, r in zip(prediction, reference, strict=True):
        a, b = str(p or "").split(), str(r or "").split()
        spans = [a[i : i + len(b)] for i in range(max(1, len(a) - len(b) + 1))]
        out.append(max(SequenceMatcher(None, " ".join(x), " ".join(b)).ratio() for x in spans))
    return pd.Series(out, dtype="float64")


# Number words and articles of the answer normaliser.
NUMBERS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = {"a", "an", "the"}
PUNCTUATION = ";/[]\"{}()=+\\_-><@`,?!"


def normal_answer(text: str) -> str:
    """Lower case, digits for number words, no articles; punctuation is cut beside blanks or in numbers with commas, else becomes a blank."""
    t = text.replace("\n", " ").replace("\t", " ").strip()
    for c in PUNCTUATION:
        t = t.replace(c, "" if f"{c} " in text or f" {c}" in text or re.search(r"\d,\d", text) else " ")
    t = re.sub(r"(?<!\d)\.(?!\d)", "", t)
    return " ".join(NUMBERS.get(w, w) for w in t.lower().split() if w not in ARTICLES)


@F.pandas_udf(T.StringType())
def answer_normal(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else normal_answer(x))


def parse_choice(response: str, letters: list[str], texts: list[str]) -> str | None:
    """The letter of a response: in brackets, else alone, else by the choice's text; of several the last one."""
    padded = f" {response.strip(',.!?;:')} "
    for mark in ("({})", " {} ", "{}."):
        spots = [(padded.rfind(mark.format(x)), x) for x in letters if mark.format(x) in padded]
        if spots:
            return max(spots)[1]
    spots = [(padded.lower().rfind(t.lower()), x) for x, t in zip(letters, texts, strict=True) if t and t.lower() in padded.lower()]
    return max(spots)[1] if spots else None


@F.pandas_udf(T.StringType())
def choice_of(response: pd.Series, texts: pd.Series, seed: pd.Series) -> pd.Series:
    """``parse_choice`` for each row; without any clue the letter follows from the row's seed."""
    out = []
    for r, t, s in zip(response, texts, seed, strict=True):
        t = list(t)
        letters = [chr(65 + k) for k in range(len(t))]
        out.append(parse_choice(r or "", letters, t) or (letters[int(s) % len(letters)] if letters else None))
    return pd.Series(out, dtype=object)


# Numbers with thousands commas, in scientific notation, and plain ones, in the order in which answers list them.
NUMBER_PATTERNS = (r"-?\b\d{1,3}(?:,\d{3})+\b", r"-?\d+(?:\.\d+)?[eE][+-]?\d+", r"-?(?:\d+\.\d+|\.\d+|\d+\b)(?![eE][+-]?\d+)(?![,\d])")


def open_numbers(c: Column) -> Column:
    """The numbers of a text as doubles rounded to two places: those with commas, then scientific, then plain ones."""
    found = F.concat(*(F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in NUMBER_PATTERNS))
    return F.transform(found, lambda n: F.round(F.replace(n, F.lit(",")).cast("double"), 2))


@F.pandas_udf(_longs("hit", "predicted", "wanted"))
def field_counts(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Shared, predicted and wanted (path, value) fields of two JSON texts; summed, they give a micro F1."""

    def fields(x, path=""):
        if isinstance(x, dict):
            return [f for k, v in x.items() for f in fields(v, f"{path}.{k}")]
        return [f for v in x for f in fields(v, path)] if isinstance(x, list) else [(path, str(x))]

    def read(text):
        try:
            return Counter(fields(json.loads(text)))
        except (TypeError, ValueError):
            return Counter()

    pairs = [(read(p), read(r)) for p, r in zip(prediction, reference, strict=True)]
    return pd.DataFrame({"hit": [(p & r).total() for p, r in pairs], "predicted": [p.total() for p, _ in pairs], "wanted": [r.total() for _, r in pairs]})


def bradley_terry(battles: list[tuple[str, str, str, int]], scale: float = 400.0, start: float = 1000.0) -> dict[str, float]:
    """Ratings from counted (model_a, model_b, winner a/b/tie, n) battles by Newton steps; the first model has ``start``."""
    models = sorted({m for a, b, _, _ in battles for m in (a, b)})
    at = {m: k for k, m in enumerate(models)}
    x, y, n = [], [], []
    for a, b, winner, k in battles:
        row = np.zeros(len(models))
        row[at[a]], row[at[b]] = 1, -1
        for hit, share in ((1, 0.5), (0, 0.5)) if winner == "tie" else ((int(winner == "a"), 1.0),):
            x.append(row)
            y.append(hit)
            n.append(k * share)
    if not x:
        return {}
    x, y, n = np.array(x), np.array(y), np.array(n, float)
    w = np.zeros(len(models))
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.pinv((x * (n * p * (1 - p))[:, None]).T @ x) @ (x.T @ (n * (y - p)))
        w = np.clip(w + step, -20, 20)
        if np.abs(step).max() < 1e-10:
            break
    return {m: float(start + scale / math.log(10) * (w[at[m]] - w[0])) for m in models}


def instruction_checks(response: Column) -> dict[str, Column]:
    """Checks of instruction following that one expression decides."""
    words = F.regexp_extract_all(response, F.lit(r"\w+"), F.lit(0))
    return {
        "n_placeholders": F.size(F.regexp_extract_all(response, F.lit(r"\[.*?\]"), F.lit(0))), "n_bullets": F.size(F.regexp_extract_all(response, F.lit(r"(?m)^\s*(?:\*[^\*]|-)"), F.lit(0))),
        "n_highlights": F.size(F.regexp_extract_all(response, F.lit(r"\*[^\n\*]+\*"), F.lit(0))), "n_paragraphs": F.size(F.filter(F.split(response, r"\n\n"), lambda x: F.trim(x) != "")),
        "n_words": F.size(words), "no_comma": ~response.contains(","), "lower_case": response == F.lower(response), "upper_case": response == F.upper(response),
        "capital_words": F.size(F.filter(words, lambda w: (w == F.upper(w)) & w.rlike("[A-Z]"))), "title": response.rlike(r"<<[^\n]+>>"), "quoted": response.rlike('^\\s*"(?s:.*)"\\s*$'),
        "postscript": response.rlike(r"(?m)^\s*P\.\s?S\."), "two_responses": F.size(F.filter(F.split(response, r"\*{6}"), lambda x: F.trim(x) != "")) == 2,
    }


def keyword_checks(response: Column, keywords: list[str], letter: str, sections: str, choices: list[str], first_word: str, end: str, prompt: Column) -> dict[str, Column]:
    """Checks of instruction following that have parameters: words, letters, sections, fixed answers, first and last words, JSON, the repeated prompt."""
    low, trimmed = F.lower(response), F.trim(response)
    count = lambda pattern: F.size(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)))
    fence = F.trim(F.regexp_replace(F.regexp_replace(trimmed, r"(?i)^```(?:json)?", ""), "```$", ""))
    paragraphs = F.filter(F.split(response, r"\n\n"), lambda x: F.trim(x) != "")
    first = F.regexp_extract(F.lower(F.trim(F.coalesce(F.get(paragraphs, F.lit(0)), F.lit("")))), r"^['\"]*([^\s.,?!'\"]*)", 1)
    return {
        "keyword_all": F.forall(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, F.lower(k))), "keyword_count": count(re.escape(keywords[0].lower())),
        "forbidden_absent": ~low.rlike("|".join(rf"\b{re.escape(k.lower())}\b" for k in keywords)), "letter_count": F.length(low) - F.length(F.replace(low, F.lit(letter.lower()))),
        "n_sections": F.size(F.split(response, rf"\s?{re.escape(sections)}\s?\d+\s?")) - 1, "constrained": F.exists(F.array(*map(F.lit, choices)), lambda x: F.contains(trimmed, x)),
        "first_word": first == first_word.lower(), "ends_with": F.endswith(F.lower(F.trim(F.regexp_replace(trimmed, '^"|"$', ""))), F.lit(end.lower())),
        "json_format": json_valid(fence), "repeats_prompt": F.startswith(F.lower(trimmed), F.lower(F.trim(prompt))),
        "n_sentences": F.size(F.filter(F.split(response, r"(?<=[.!?])\s+"), lambda x: x.rlike(r"\w"))),
    }


def loosened(response: Column) -> Column:
    """The eight loose variants: as it is or without stars, and without the first line, the last or both."""
    lines = F.split(response, "\n")
    size = F.size(lines)
    cut = [response, F.array_join(F.slice(lines, 2, 1 << 30), "\n"), F.array_join(F.slice(lines, F.lit(1), F.greatest(size - 1, F.lit(0))), "\n"), F.array_join(F.slice(lines, F.lit(2), F.greatest(size - 2, F.lit(0))), "\n")]
    return F.array(*cut, *(F.replace(c, F.lit("*"), F.lit("")) for c in cut))
