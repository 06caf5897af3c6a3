"""Overlap of generated and wanted outputs: caption consensus, edits with shifts, trees."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgauge.functions.corpus import edit_distance, ngrams


def cider(df: DataFrame, key: str, prediction: str, reference: str, most: int = 4, sigma: float = 6.0) -> DataFrame:
    """(key, cider): ten times the mean over orders of clipped tf-idf cosines, damped by the difference in length.

    Document frequencies are those of the references. Keys must be unique; a null side has no words.
    """
    words = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"), lambda w: w != "")
    base = df.select(key, words(prediction).alias("p"), words(reference).alias("r"))
    one = lambda side, n: F.transform(ngrams(F.col(side), n), lambda g: F.struct(F.lit(n).alias("n"), F.lit(side).alias("side"), g.alias("gram")))
    bigrams = lambda side: F.greatest(F.size(side) - 1, F.lit(0))
    grams = base.select(key, (bigrams("p") - bigrams("r")).alias("delta"), F.inline(F.concat(*(one(s, n) for s in "pr" for n in range(1, most + 1)))))
    tf = grams.groupBy(key, "n", "gram").agg(F.count_if(F.col("side") == "p").alias("a"), F.count_if(F.col("side") == "r").alias("b"), F.first("delta").alias("delta"))
    spread = tf.where("b > 0").groupBy("n", "gram").agg(F.count(F.lit(1)).alias("df"))
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("rows")))  # one row
    idf = F.log("rows") - F.log(F.coalesce("df", F.lit(1)))
    weighed = tf.join(spread, ["n", "gram"], "left").crossJoin(total).select(key, "n", "delta", (F.col("a") * idf).alias("a"), (F.col("b") * idf).alias("b"))
    dots = weighed.groupBy(key, "n").agg(F.sum(F.least("a", "b") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"), F.first("delta").alias("delta"))
    value = F.coalesce(F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb")), F.lit(0.0)) * F.exp(-F.col("delta") * F.col("delta") / (2 * sigma**2))
    scores = dots.groupBy(key).agg((10 * F.sum(value) / most).alias("cider"))
    return df.select(key).join(scores, key, "left").select(key, F.coalesce("cider", F.lit(0.0)).alias("cider"))


def shifted_edits(a: list[str], b: list[str], longest: int = 10) -> int:
    """Edits from ``a`` to ``b`` where moving a run of words that ``b`` has elsewhere is one edit, chosen greedily."""
    moves, now = 0, edit_distance(a, b)
    while now > 1:
        best = None
        runs = {tuple(b[j : j + n]): j for n in range(1, min(longest, len(b)) + 1) for j in range(len(b) - n, -1, -1)}
        for n in range(min(longest, len(a)), 0, -1):
            for i in range(len(a) - n + 1):
                j = runs.get(tuple(a[i : i + n]))
                if j is None or j == i:
                    continue
                rest = a[:i] + a[i + n :]
                moved = rest[:j] + a[i : i + n] + rest[j:]
                left = edit_distance(moved, b)
                if left + 1 < now and (best is None or left < best[0]):
                    best = left, moved
        if best is None:
            break
        now, a = best
        moves += 1
    return moves + now


@F.pandas_udf(T.StructType([T.StructField("edits", T.LongType()), T.StructField("length", T.LongType())]))
def translation_edits(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Edits with shifts and reference length of each row; the rate is the ratio of their sums."""
    pairs = [((p or "").lower().split(), (r or "").lower().split()) for p, r in zip(prediction, reference, strict=True)]
    return pd.DataFrame({"edits": [shifted_edits(p, r) for p, r in pairs], "length": [len(r) for _, r in pairs]})


LEAF = "<leaf>"


def tree_of(value, name: str = "<root>") -> tuple[str, list]:
    """(label, children) of a JSON value; members by length and name, scalars as leaves, empty ones left out."""
    if isinstance(value, dict):
        return name, [tree_of(value[k], k) for k in sorted(value, key=lambda k: (len(k), k)) if value[k] not in (None, "", [], {})]
    if not isinstance(value, list):
        value = [value]
    if all(isinstance(x, dict) for x in value):
        return name, [tree_of(x, "<subtree>") for x in value]
    return name, [(f"{LEAF}{str(x).strip()}", []) for x in value]


def _cost(a: str | None, b: str | None) -> int:
    """Cost of turning label ``a`` into ``b``; None stands for no node."""
    leaf = lambda x: x is not None and x.startswith(LEAF)
    size = lambda x: len(x) - len(LEAF) if leaf(x) else 1
    if a is None or b is None:
        return size(a if b is None else b)
    if leaf(a) and leaf(b):
        return edit_distance(list(a), list(b))
    return size(a) + size(b) if leaf(a) != leaf(b) else int(a != b)


def tree_distance(a: tuple[str, list], b: tuple[str, list]) -> int:
    """Ordered tree edit distance by key roots (Zhang and Shasha 1989)."""

    def laid(tree):
        labels, left = [], []

        def walk(node):
            low = None
            for kid in node[1]:
                first = walk(kid)
                low = first if low is None else low
            labels.append(node[0])
            left.append(len(labels) - 1 if low is None else low)
            return left[-1]

        walk(tree)
        return labels, left, sorted({x: i for i, x in enumerate(left)}.values())

    (la, fa, ka), (lb, fb, kb) = laid(a), laid(b)
    whole = [[0] * len(lb) for _ in la]
    for i in ka:
        for j in kb:
            m, n = i - fa[i] + 2, j - fb[j] + 2
            d = [[0] * n for _ in range(m)]
            for x in range(1, m):
                d[x][0] = d[x - 1][0] + _cost(la[fa[i] + x - 1], None)
            for y in range(1, n):
                d[0][y] = d[0][y - 1] + _cost(None, lb[fb[j] + y - 1])
            for x in range(1, m):
                for y in range(1, n):
                    u, v = fa[i] + x - 1, fb[j] + y - 1
                    edge = min(d[x - 1][y] + _cost(la[u], None), d[x][y - 1] + _cost(None, lb[v]))
                    if fa[u] == fa[i] and fb[v] == fb[j]:
                        d[x][y] = whole[u][v] = min(edge, d[x - 1][y - 1] + _cost(la[u], lb[v]))
                    else:
                        d[x][y] = min(edge, d[fa[u] - fa[i]][fb[v] - fb[j]] + whole[u][v])
    return whole[-1][-1]


def _tree(text: str | None) -> tuple[str, list]:
    try:
        return tree_of(json.loads(text))
    except (TypeError, ValueError):
        return tree_of({})


@F.pandas_udf(T.DoubleType())
def tree_accuracy(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """1 - distance over the reference's distance from an empty tree, at least 0; 0 to 0 counts as 1."""
    out = []
    for p, r in zip(prediction, reference, strict=True):
        want = _tree(r)
        whole, far = tree_distance(tree_of({}), want), tree_distance(_tree(p), want)
        out.append(max(0.0, 1 - far / whole) if whole else float(far == 0))
    return pd.Series(out, dtype="float64")


def spoken(c: Column, language: str = "en") -> Column:
    """A transcript without <|marks|>, with single blanks and none before punctuation; words of punctuation alone go."""
    c = F.regexp_replace(F.regexp_replace(c, r"<\|.*?\|>", " "), r"\s+", " ")
    c = F.ltrim(F.regexp_replace(c, r" ?([!,.?;:])", "$1"))
    if language == "zh":
        return F.regexp_replace(c, r"\s+", "")
    return F.array_join(F.filter(F.split(c, " "), lambda w: ~w.rlike(r"^\p{P}+$")), " ")
