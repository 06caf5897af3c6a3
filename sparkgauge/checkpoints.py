"""Lineage cuts that survive lost executors.

Every iterative operator writes its intermediate tables to the folder named in
``spark.checkpoint.dir``. The setting is read from the session; a folder is chosen
here only where the session has none, as in local tests.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_dir(spark: SparkSession) -> None:
    """Make sure the context has a checkpoint folder, preferring the cluster's own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkgauge-checkpoint-"))


def few(df: DataFrame, rows: int, each: int = 250_000) -> DataFrame:
    """``df`` in about one task for ``each`` rows, but no more tasks than it has.

    For tables whose size is known: what comes next writes few shuffle files where rows are few.
    """
    return df.coalesce(max(1, -(-rows // each)))


def cut(df: DataFrame, each: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return the written table.

    With ``each``, the table is read by about one task for so many rows (and by as many
    as the cluster runs at once, if it has so many partitions).
    """
    ensure_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if each is None:
        return out
    return out.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-out.count() // each)))
