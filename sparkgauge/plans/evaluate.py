"""The evaluation of tasks: documents, requests, responses, filters, metrics, groups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.checkpoints import cut
from sparkgauge.functions.filters import pipeline
from sparkgauge.functions.metrics import mean_stderr, pooled_stderr, weighted_mean
from sparkgauge.plans.requests import doc_to, repeats, shard_limit
from sparkgauge.registry import METRICS, RESPONDERS


@METRICS.register("exact_match")
def exact_match(response: Column, target: Column) -> Column:
    return (F.lower(F.trim(response)) == F.lower(F.trim(target))).cast("double")


@METRICS.register("contains")
def contains(response: Column, target: Column) -> Column:
    return response.contains(target).cast("double")


@RESPONDERS.register("echo")
def echo(requests: DataFrame) -> DataFrame:
    """A deterministic stand-in for a model: the first word of the context."""
    return requests.withColumn("response", F.regexp_extract("ctx", r"\S+", 0))


@dataclass
class Task:
    name: str
    docs: DataFrame  # with doc_id
    text: str | Callable[[], Column]
    target: str | Callable[[], Column]
    metrics: tuple[str, ...] = ("exact_match",)
    filters: dict[str, list[tuple]] = field(default_factory=lambda: {"none": [("take_first",)]})
    repeats: int = 1
    limit: float | None = None


@dataclass
class Result:
    samples: DataFrame
    task_results: DataFrame
    group_results: DataFrame


def inherit(base: dict, own: dict) -> dict:
    """A configuration over the one it includes; nested tables are merged, the rest replaced."""
    return base | {k: inherit(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in own.items()}


def requests_of(task: Task) -> DataFrame:
    docs = shard_limit(task.docs, limit=task.limit)
    columns = task.docs.columns
    base = docs.select(F.lit(task.name).alias("task"), "doc_id", doc_to(task.text, columns).alias("ctx"), doc_to(task.target, columns).cast("string").alias("target"))
    return repeats(base, task.repeats)


def evaluate(spark: SparkSession, tasks: list[Task], respond: str | Callable[[DataFrame], DataFrame], groups: dict[str, list[str]] | None = None) -> Result:
    """Samples, task results and group results.

    ``respond`` takes requests (task, doc_id, ctx, target, rep) and adds ``response``. It is
    asked once for each request: the responses are written to the checkpoint folder, and all
    filters and results read them there. All metrics of a task come from one aggregation.
    """
    responder = RESPONDERS.find(respond) if isinstance(respond, str) else respond
    frames = []
    for task in tasks:
        answered = responder(requests_of(task)).groupBy("task", "doc_id").agg(F.first("target").alias("target"), F.array_sort(F.collect_list(F.struct("rep", "response"))).alias("r"))
        answered = cut(answered.select("task", "doc_id", "target", F.col("r.response").alias("resps")))
        for name, steps in task.filters.items():
            got = pipeline(steps)(F.col("resps"))
            kept = answered.withColumn("filtered", got)
            if kept.schema["filtered"].dataType.simpleString().startswith("array"):
                kept = kept.withColumn("filtered", F.get("filtered", F.lit(0)))
            scored = F.array(*(F.struct(F.lit(m).alias("metric"), METRICS.find(m)(F.col("filtered"), F.col("target")).alias("value")) for m in task.metrics))
            frames.append(kept.select("task", F.lit(name).alias("filter_name"), "doc_id", "target", "filtered", F.inline(scored)))
    samples = reduce(DataFrame.unionByName, frames)
    results = samples.groupBy("task", "metric", "filter_name").agg(F.avg("value").alias("value"), mean_stderr(F.col("value")).alias("stderr"), F.count("value").alias("n"))
    members = [(g, t) for g, ts in (groups or {"all": [t.name for t in tasks]}).items() for t in ts]
    edges = F.broadcast(spark.createDataFrame(members, "group_name string, task string"))
    rolled = results.join(edges, "task").groupBy("group_name", "metric", "filter_name")
    return Result(samples, results, rolled.agg(weighted_mean(F.col("value"), F.col("n")).alias("value"), pooled_stderr(F.col("stderr"), F.col("n")).alias("stderr"), F.sum("n").alias("n")))
