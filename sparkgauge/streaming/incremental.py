"""An extension: metrics kept up to date over a stream of scored samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_mean(samples: DataFrame, time: str, keys: list[str], value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, keys, value, n) per tumbling window; works on batch and on streaming tables."""
    source = samples.withWatermark(time, late) if samples.isStreaming else samples
    return source.groupBy(F.window(time, width).alias("w"), *keys).agg(F.avg(value).alias("value"), F.count(value).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "value", "n")
