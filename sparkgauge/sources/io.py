"""Sources and sinks beyond plain Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.functions.text import srt_seconds


def read_by_extension(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV, TSV, JSON lines, ORC, text or Parquet, by the end of the path."""
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if end in ("csv", "tsv"):
        return reader.csv(path, sep="\t" if end == "tsv" else ",", header=True, multiLine=True, escape='"')
    if end in ("json", "jsonl"):
        return reader.json(path)
    return {"orc": reader.orc, "txt": spark.read.text}.get(end, reader.parquet)(path)


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """(path, start_s, end_s, text) of SRT files."""
    blocks = spark.read.text(path, lineSep="\n\n").select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r", "").alias("b"))
    times = r"(\d+:\d+:\d+[,.]\d+)\s*-->\s*(\d+:\d+:\d+[,.]\d+)[^\n]*\n(?s:(.*))"
    part = lambda k: F.regexp_extract("b", times, k)
    found = blocks.where(F.col("b").rlike(r"\d+:\d+:\d+[,.]\d+\s*-->"))
    return found.select("path", srt_seconds(part(1)).alias("start_s"), srt_seconds(part(2)).alias("end_s"), F.trim(F.regexp_replace(part(3), "\n", " ")).alias("text"))


def read_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON logs below a folder, the latest for each task."""
    logs = spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
    top = logs.groupBy("task").agg(F.max_by(F.struct(*logs.columns), F.struct("time", F.xxhash64(*logs.columns))).alias("r"))
    return top.select("r.*")


def write_samples(samples: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines, one folder for each task."""
    samples.write.mode("append" if append else "errorifexists").partitionBy("task").json(path)


def write_results(results: DataFrame, path: str) -> None:
    """A small table of aggregated results as one JSON file."""
    results.coalesce(1).write.mode("overwrite").json(path)


def write_submission(answers: DataFrame, path: str, kind: str = "json") -> None:
    answers.write.mode("overwrite").option("header", True).format(kind).save(path)


def markdown(results: DataFrame) -> str:
    """A small table of results as markdown."""
    rows = results.collect()
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else "N/A" if v is None else str(v)
    lines = ["|" + "|".join(results.columns) + "|", "|" + "|".join("---" for _ in results.columns) + "|"]
    return "\n".join(lines + ["|" + "|".join(cell(v) for v in r) + "|" for r in rows])
