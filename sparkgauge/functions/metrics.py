"""Aggregations as Column aggregates, and their errors. All metrics of one family belong in one ``agg`` call."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgauge.registry import AGGREGATIONS

ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))


@AGGREGATIONS.register("mean")
def mean(x: Column) -> Column:
    return F.avg(x)


@AGGREGATIONS.register("bypass")
def bypass(x: Column) -> Column:
    return F.max(F.lit(999))


@AGGREGATIONS.register("median")
def median(x: Column) -> Column:
    """The interpolated median."""
    return F.percentile(x, F.lit(0.5))


@AGGREGATIONS.register("perplexity")
def perplexity(x: Column) -> Column:
    return F.exp(-F.avg(x))


@AGGREGATIONS.register("weighted_perplexity")
def weighted_perplexity(a: Column, b: Column) -> Column:
    return F.exp(-ratio(F.sum(a), F.sum(b)))


@AGGREGATIONS.register("bits_per_byte")
def bits_per_byte(a: Column, b: Column) -> Column:
    return -ratio(F.sum(a), F.sum(b)) / F.log(F.lit(2.0))


def counts(gold: Column, pred: Column) -> tuple[Column, Column, Column, Column]:
    """(true positives, false positives, false negatives, true negatives) of 0/1 columns."""
    return F.count_if((gold == 1) & (pred == 1)), F.count_if((gold == 0) & (pred == 1)), F.count_if((gold == 1) & (pred == 0)), F.count_if((gold == 0) & (pred == 0))


@AGGREGATIONS.register("f1")
def f1(gold: Column, pred: Column) -> Column:
    tp, fp, fn, _ = counts(gold, pred)
    return F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


@AGGREGATIONS.register("precision")
def precision(gold: Column, pred: Column) -> Column:
    tp, fp, _, _ = counts(gold, pred)
    return F.coalesce(ratio(tp, tp + fp), F.lit(0.0))


@AGGREGATIONS.register("recall")
def recall(gold: Column, pred: Column) -> Column:
    tp, _, fn, _ = counts(gold, pred)
    return F.coalesce(ratio(tp, tp + fn), F.lit(0.0))


@AGGREGATIONS.register("matthews_corrcoef")
def matthews(gold: Column, pred: Column) -> Column:
    tp, fp, fn, tn = (c.cast("double") for c in counts(gold, pred))
    return F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0))


@AGGREGATIONS.register("brier_score")
def brier(probabilities: Column, gold: Column) -> Column:
    off = F.transform(probabilities, lambda x, i: F.pow(x - F.when(i == gold, 1.0).otherwise(0.0), F.lit(2)))
    return F.avg(F.aggregate(off, F.lit(0.0), lambda a, b: a + b))


@AGGREGATIONS.register("mean_stderr")
def mean_stderr(x: Column) -> Column:
    """Sample standard error of a mean; null for one row."""
    return ratio(F.stddev_samp(x), F.sqrt(F.count(x)))


def pooled_stderr(stderr: Column, n: Column) -> Column:
    """Standard error of the size-weighted mean of groups."""
    spread = F.try_divide(F.sum((n - 1) * stderr * stderr * n), (F.sum(n) - F.count(n)).cast("double"))
    return F.sqrt(F.try_divide(spread, F.sum(n).cast("double")))


def weighted_mean(value: Column, n: Column) -> Column:
    return ratio(F.sum(value * n), F.sum(n))


def matthews_many(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Matthews correlation of any number of classes, as ``mcc`` (0 where undefined); rows with a null are left out."""
    cells = df.select(F.col(gold).alias("g"), F.col(pred).alias("p")).dropna().groupBy("g", "p").agg(F.count(F.lit(1)).cast("double").alias("n"))
    sides = cells.select("n", F.explode(F.array(F.struct("g", F.lit(0).alias("side")), F.struct(F.col("p").alias("g"), F.lit(1).alias("side")))).alias("s"))
    classes = sides.groupBy("s.g").agg(*(F.sum(F.when(F.col("s.side") == k, F.col("n")).otherwise(0.0)).alias(c) for k, c in enumerate("tp")))
    sums = classes.agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0.0)).alias("right"))
    nn = F.col("n") * F.col("n")
    mcc = F.try_divide(F.col("right") * F.col("n") - F.col("tp"), F.sqrt((nn - F.col("pp")) * (nn - F.col("tt"))))
    return total.join(sums, F.lit(True)).select(F.coalesce(mcc, F.lit(0.0)).alias("mcc"))


def max_over_truths(metric: Callable[[Column, Column], Column], prediction: Column, truths: Column) -> Column:
    """The best value of a metric against each of an array of truths; null without truths."""
    return F.array_max(F.transform(truths, lambda t: metric(prediction, t)))


def bootstrap_stderr(df: DataFrame, id_col: str, statistic: Column, replicates: int, seed: str = "") -> DataFrame:
    """Standard error of an aggregation as ``stderr``, over Poisson replicates whose weights are hashes of (seed, replicate, id)."""
    u = F.xxhash64(F.lit(seed), F.col("__b"), F.col(id_col)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / float(1 << 52)
    limits = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]
    weight = sum(((u >= q).cast("int") for q in limits), F.lit(0))
    drawn = df.withColumn("__b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("__w", F.explode(F.array_repeat(F.lit(1), weight)))
    return drawn.groupBy("__b").agg(statistic.alias("__s")).agg(F.stddev_samp("__s").alias("stderr"))


#: Aggregations whose errors are bootstrapped, and those of them that get few replicates.
BOOTSTRAPPED = ("median", "matthews_corrcoef", "f1", "perplexity", "bleu", "chrf", "ter")
COSTLY, COSTLY_REPLICATES = ("bleu", "chrf", "ter"), 100


def stderr_for(name: str, replicates: int) -> Callable[[DataFrame, str, Column, Column], DataFrame] | None:
    """How the error of an aggregation is found: a function of (rows, id column, value, statistic), or None if it has none.

    A mean has its sample error; the bootstrapped ones have that of replicates of the statistic.
    """
    if replicates <= 0:
        return None
    if name in BOOTSTRAPPED:
        rounds = min(replicates, COSTLY_REPLICATES) if name in COSTLY else replicates
        return lambda df, key, value, statistic: bootstrap_stderr(df, key, statistic, rounds, name)
    if name in ("mean", "acc_all"):
        return lambda df, key, value, statistic: df.agg(mean_stderr(value).alias("stderr"))
    return None
