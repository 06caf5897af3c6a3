"""One query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.llm import decontaminate, license_scan, line_dedup, near_dup, packing, pii, quality_crf, quality_rules, secret_scan, sharding

SHARDS = [f"shard-{k:03d}" for k in range(sharding.SHARDS)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, runs=True)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARDS)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_crf.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return quality_crf.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = quality_rules.ratios(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, ratios).drop("text")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the key of the session; the driver's tables are made up, so without one a fixed key does (``pii.replace`` has no default)."""
    key = spark.conf.get("spark.sparkgauge.pii.key", "only for made-up tables")
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_line_dedup, op2_sharding, op3_packing, op4_quality_crf, op5_quality_rules, op6_pii, op7_secret_scan, op8_decontamination, op9_license_scan, op10_near_duplicates)
    return {f.__name__: f for f in ops}


_SHARDING_SQL = f"""
WITH RECURSIVE orders AS (
  SELECT i, ('0x' || substr(md5('offset:' || printf('shard-%03d', i)), 1, 8))::BIGINT % {sharding.SLOTS} AS offset_,
         ('0x' || substr(md5('step:' || printf('shard-%03d', i)), 1, 8))::BIGINT % {sharding.SLOTS - 1} + 1 AS step_
  FROM range({sharding.SHARDS}) t(i)
), claims(turn, slot, taken) AS (
  SELECT 0::BIGINT, offset_, [offset_] FROM orders WHERE i = 0
  UNION ALL
  SELECT turn + 1, free, list_append(taken, free) FROM (
    SELECT turn, taken, list_filter(list_transform(range({sharding.SLOTS}), lambda j: (offset_ + j * step_) % {sharding.SLOTS}), lambda s: NOT list_contains(taken, s))[1] AS free
    FROM claims JOIN orders ON orders.i = (turn + 1) % {sharding.SHARDS}
    WHERE len(taken) < {sharding.SLOTS}
  )
), keyed AS (
  SELECT doc_id, (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {sharding.SLOTS}) AS slot FROM documents
)
SELECT doc_id, keyed.slot::INTEGER AS slot, printf('shard-%03d', turn % {sharding.SHARDS}) AS shard
FROM keyed JOIN claims ON claims.slot = keyed.slot
"""

_NEAR_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM split
), posts AS (
  SELECT doc_id, unnest(s) AS g FROM sets
), rich AS (
  SELECT g FROM posts GROUP BY g HAVING count(*) > 1
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM (SELECT * FROM posts SEMI JOIN rich USING (g)) a JOIN (SELECT * FROM posts SEMI JOIN rich USING (g)) b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)
), reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, low AS component_id, doc_id = low AS kept
FROM sets JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id) USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": _SHARDING_SQL, "op10_near_duplicates": _NEAR_SQL}
