"""Connected components on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgauge.checkpoints import cut, few


#: A key is hot with more than this many rows and more than this share of all rows, so there are at most HOT_SHARE hot keys.
HOT_ROWS, HOT_SHARE = 2000, 1000


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: int, narrow: DataFrame | None = None) -> DataFrame:
    """The inner join on ``key`` of ``left``, of about ``rows`` rows, with ``right``, of few rows a key.

    ``narrow`` has the rows of ``left`` with some of its columns, for counting keys at less cost.

    Rows of a hot key of ``left`` are dealt to as many tasks as they need, and the rows of
    ``right`` for it are repeated there. Only the hot keys reach the driver and are
    broadcast, HOT_SHARE at most; without any the join is a plain one.
    """
    least, narrow = max(HOT_ROWS, rows // HOT_SHARE), left if narrow is None else narrow
    counted = narrow.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).collect()
    if not counted:
        return left.join(right, key)
    kind = T.StructType([T.StructField(key, narrow.schema[key].dataType), T.StructField("__parts", T.IntegerType())])
    hot = F.broadcast(left.sparkSession.createDataFrame([(r[0], -(-r[1] // least)) for r in counted], kind))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("__part", F.pmod(F.xxhash64(*narrow.columns), parts).cast("int")).drop("__parts")
    repeated = right.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(repeated, [key, "__part"]).drop("__part")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of an undirected edge table with the smallest node it reaches.

    ``edges`` has columns ``u`` and ``v`` of one orderable type. Returns ``node`` and
    ``component``. Self loops keep an isolated node in the result; nulls are dropped;
    repeated edges count once; an empty table gives an empty result.

    Alternates two rewrites until the edge table stops changing. The first links each
    node's larger neighbours to its smallest neighbour, the second links all smaller
    neighbours to it, so long paths shrink by a factor each round and no node ever
    collects more links than it had. Each round is one shuffle and aggregates before it;
    neighbourhoods are never gathered in one row, nor the links of a hub in one task.
    """
    clean = edges.select("u", "v").where(F.col("u").isNotNull() & F.col("v").isNotNull())
    alone = clean.where("u = v").select(F.col("u").alias("node")).distinct()
    links = cut(clean.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    rows = links.count()
    nodes, before = few(links, rows).select(F.explode(F.array("u", "v")).alias("node")).unionByName(alone).distinct(), None
    for _ in range(max_rounds):
        links = few(links, rows)
        # large step: every neighbour above a node is linked to the node's minimum
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = few(spread_join(both, low, "u", 2 * rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), rows).distinct()
        # small step: a node and its neighbours below it are linked to their minimum
        low = few(large, rows).groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(few(large, rows), low, "u", rows).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        links = cut(few(small, rows).distinct())
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        rows = now[0]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    found = few(links, rows).select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
