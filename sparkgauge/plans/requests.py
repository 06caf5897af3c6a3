"""From documents to requests and back: templates, fan-out, shards, joins and windows."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def template(text: str, columns: list[str]) -> Column:
    """A text with {{column}} marks as one expression; an unknown column is an error."""
    parts = re.split(r"\{\{\s*([\w.]+)\s*\}\}", text)
    if unknown := set(parts[1::2]) - set(columns):
        raise ValueError(f"unknown columns in template: {sorted(unknown)}")
    return F.concat(*(F.coalesce(F.col(p).cast("string"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)))


def doc_to(spec: str | Callable[[], Column], columns: list[str]) -> Column:
    """A column name, a template or a function that gives a Column."""
    if callable(spec):
        return spec()
    return F.col(spec) if spec in columns else template(spec, columns)


def choice_requests(docs: DataFrame, mutual_info: bool = False) -> DataFrame:
    """One request for each (doc_id, choice); with ``mutual_info`` a second one without context."""
    each = docs.select("doc_id", "ctx", F.posexplode("choices").alias("idx", "cont"))
    cond = each.select("doc_id", "idx", F.lit("cond").alias("kind"), "ctx", "cont")
    return cond.unionByName(each.select("doc_id", "idx", F.lit("uncond").alias("kind"), F.lit("").alias("ctx"), "cont")) if mutual_info else cond


def repeats(requests: DataFrame, k: int) -> DataFrame:
    return requests.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(k))))


def shard_limit(docs: DataFrame, rank: int = 0, world: int = 1, limit: float | None = None, id_col: str = "doc_id") -> DataFrame:
    """Rows of a rank below a limit: a count, or a share (below 1) of the rows, rounded up."""
    out = docs
    if limit is not None:
        top = F.lit(limit) if limit >= 1 else F.lit(-int(-(docs.count() * limit) // 1))
        out = out.where(F.col(id_col) < top)
    return out.where(F.col(id_col) % world == rank)


def few_shot(docs: DataFrame, shots: DataFrame, delimiter: str) -> DataFrame:
    """``ctx`` behind the given shots, in the order of their ids and without a document's own one. Shots are few."""
    every = shots.agg(F.array_sort(F.collect_list(F.struct("shot_id", "shot"))).alias("shots"))
    own = F.filter("shots", lambda x: x["shot_id"] != F.col("doc_id"))
    return docs.join(F.broadcast(every), F.lit(True)).select("doc_id", F.array_join(F.concat(F.transform(own, lambda x: x["shot"]), F.array("ctx")), delimiter).alias("ctx"))


def random_shots(docs: DataFrame, shots: DataFrame, n: int, delimiter: str, seed: str = "", most: int = 1000) -> DataFrame:
    """``ctx`` behind ``n`` shots drawn for each document by hashed order, never its own one.

    The draw depends on the seed, the document and the shot alone. Shots are repeated in every
    task, so more than ``most`` of them are an error. With fewer than ``n``, all are taken.
    """
    if shots.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} shots to draw from")
    every = shots.agg(F.collect_list(F.struct("shot_id", "shot")).alias("shots"))
    own = F.filter("shots", lambda x: ~x["shot_id"].eqNullSafe(F.col("doc_id")))
    rank = lambda x: F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), x["shot_id"].cast("string")))
    drawn = F.slice(F.array_sort(F.transform(own, lambda x: F.struct(rank(x).alias("rank"), x["shot_id"], x["shot"]))), 1, n)
    texts = F.concat(F.transform(drawn, lambda x: x["shot"]), F.array("ctx"))
    return docs.join(F.broadcast(every), F.lit(True)).select("doc_id", F.array_join(texts, delimiter).alias("ctx"))


def replay(requests: DataFrame, log: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Requests with the responses of a log."""
    return requests.join(log, list(keys))


def through_cache(requests: DataFrame, store: DataFrame, model: Callable[[DataFrame], DataFrame], key: str = "key") -> DataFrame:
    """Answers from the store where it has the key, else from the model."""
    return requests.join(store, key).unionByName(model(requests.join(store, key, "left_anti")))


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, bin_width: int) -> DataFrame:
    """Pairs with low <= at < high, as an equal join on bins of ``bin_width``."""
    binned = ranges.where(F.col(low) < F.col(high)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / bin_width), F.floor((F.col(high) - 1e-9) / bin_width))))
    return points.withColumn("__bin", F.floor(F.col(at) / bin_width)).join(binned, "__bin").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__bin")


def run_lengths(df: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """``run``: at the last 1 of each run of 1s its length, else 0."""
    w = W.partitionBy(*keys).orderBy(order)
    x = df.withColumn("__g", F.sum((F.col(flag) == 0).cast("int")).over(w)).withColumn("__n", F.lead(flag, 1, 0).over(w))
    total = F.sum(flag).over(W.partitionBy(*keys, "__g"))
    return x.withColumn("run", F.when((F.col(flag) == 1) & (F.col("__n") == 0), total).otherwise(0)).drop("__g", "__n")


def chunks(array: Column, size: int) -> Column:
    """Tumbling chunks of an array."""
    return F.when(F.size(array) > 0, F.transform(F.sequence(F.lit(0), F.ceil(F.size(array) / size).cast("int") - 1), lambda i: F.slice(array, i * size + 1, F.lit(size))))


def rolling_windows(tokens: Column, prefix: Column, size: int, context: int) -> Column:
    """Structs (input, pred) of windows that predict each token once.

    The first window predicts ``size`` tokens behind ``prefix``; each further one predicts up
    to ``size - context + 1`` tokens from ``size`` inputs. No tokens give no windows.
    """
    if not 1 <= context <= size:
        raise ValueError("context must be between 1 and the window's size")
    step, n = size - context + 1, F.size(tokens)
    first = F.array(F.struct(F.concat(F.array(prefix), F.slice(tokens, 1, F.least(F.lit(size), F.greatest(n, F.lit(1))) - 1)).alias("input"), F.slice(tokens, 1, F.lit(size)).alias("pred")))

    def later(at: Column) -> Column:
        end = F.least(at + step, n)
        return F.struct(F.slice(tokens, end - size, F.lit(size)).alias("input"), F.slice(tokens, at + 1, end - at).alias("pred"))

    rest = F.when(n > size, F.transform(F.sequence(F.lit(size), F.greatest(n - 1, F.lit(size)), F.lit(step)), later)).otherwise(F.slice(first, 1, 0))
    return F.when(n > 0, F.concat(first, rest)).otherwise(F.slice(first, 1, 0))


def disjoint(window: Column) -> Column:
    """The window with its input cut where its predicted tokens begin."""
    a, b = window["input"], window["pred"]
    return F.struct(F.slice(a, F.lit(1), F.size(a) - F.size(b) + 1).alias("input"), b.alias("pred"))


def uniform_sample(total: Column, n: int) -> Column:
    """``n`` evenly spread positions below ``total``, the last one included."""
    if n == 1:
        return F.array(F.lit(0).cast("long"))
    step = (total - 1) / float(n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, total - 1).otherwise((i * step).cast("long")))


def top_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def glob(c: Column, pattern: str) -> Column:
    return c.rlike(f"^{fnmatch.translate(pattern).replace('(?s:', '(?:').replace('(?>', '(?>').removesuffix(chr(92) + 'z').removesuffix(chr(92) + 'Z')}$")
