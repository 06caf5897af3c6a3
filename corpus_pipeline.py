"""The corpus pipeline: raw documents in, packed token windows out.

Every stage takes rows with null ids or texts, empty and very long texts, ties, repeated rows,
further columns of any names (but for those beginning with two underscores) and empty
tables; what becomes of them is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.checkpoints import cut
from sparkgauge.llm import decontaminate, line_dedup, near_dup, packing, quality_crf
from sparkgauge.llm.queries import held_out, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model does not reject.

    A null or empty text is one empty line and is judged as such; repeated rows are judged
    alike; without labels nothing is rejected; an empty table gives an empty result. Columns
    named ``score`` and ``predicted`` are given back as they were.
    """
    model = quality_crf.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    kept = {"score": "__score", "predicted": "__predicted"}
    scored = quality_crf.score(docs.withColumnsRenamed(kept), model).where("predicted = 1").drop("score", "predicted")
    return scored.withColumnsRenamed({new: old for old, new in kept.items()})


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of lines; ``n_chars``, if there is one, follows the text.

    All rows stay; a text can become empty, a null one stays null. Repeated rows (one id and
    one text) count as one place and keep their lines alike. An empty table gives an empty
    result. Columns named ``removed_lines`` and ``removed_chunks`` are dropped.
    """
    out = line_dedup.dedup_lines(docs, runs=True).drop("removed_lines", "removed_chunks")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of a similarity of 0.8 or more.

    Of rows with one id and one text, one stays, also where the id is null; rows with a null
    id are else no copies of others. Rows of one id with different texts stay or go together.
    Null and empty texts are no copies, but for repeated rows. An empty table gives an empty
    result.
    """
    dropped = cut(near_dup.near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct())
    left = docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    again = docs.groupBy(F.col("doc_id").alias("__again")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__again")
    same = F.col("doc_id").eqNullSafe(F.col("__again"))
    once = left.join(again, same, "left_anti")
    several = left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(several).select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without items of the benchmark.

    Null and empty texts stay; repeated rows stay or go together; without items all stay; an
    empty table gives an empty result.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in windows of tokens.

    Null and empty texts are one separator; repeated rows are packed each; a null id stays
    null; other columns end here. An empty table gives an empty result.
    """
    return packing.pack(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", duplicates), ("decontamination", benchmark), ("packing", pack)]

#: The stages learn a model and follow content-defined borders, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the documents table; each result is written to the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
