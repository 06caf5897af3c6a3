"""Queries of the vector and graph operators. A label stands for a patch type, the rank in it for a frame."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkgauge.functions.vector import cosine
from sparkgauge.operators import selection as G
from sparkgauge.operators.graph import connected_components
from sparkgauge.registry import query, table

R4 = lambda c: F.round(c, 4) + F.lit(0.0)
WIDTH = 64
_F = "SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings"
_S = f"SELECT *, list_cosine_similarity(e, lag(e) OVER (PARTITION BY label ORDER BY vec_id)) AS sim, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM ({_F})"
TAU = 0.2


def frames(s, d):
    e = table(s, d, "embeddings")
    return e.withColumn("frame", F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1)


def similar(s, d):
    w = W.partitionBy("label").orderBy("vec_id")
    return G.lagged(frames(s, d), ["label"], "vec_id", "embedding").withColumn("prev", F.lag("vec_id").over(w))


def edges(s, d):
    return similar(s, d).where(F.col("sim") >= TAU).select(F.col("prev").alias("u"), F.col("vec_id").alias("v"), F.col("sim").alias("w"))


@query("G1_W1_lag_similarity", f"SELECT vec_id, round(sim, 4) + 0.0 AS sim FROM ({_S})")
def _(s, d):
    return similar(s, d).select("vec_id", R4("sim").alias("sim"))


@query("W2_lag_k", f"SELECT vec_id, round(list_cosine_similarity(e, lag(e, 3) OVER (PARTITION BY label ORDER BY vec_id)), 4) + 0.0 AS sim FROM ({_F})")
def _(s, d):
    return G.lagged(frames(s, d), ["label"], "vec_id", "embedding", 3).select("vec_id", R4("sim").alias("sim"))


@query("G2_neighbours", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], r.embedding::DOUBLE[]), 4) + 0.0 AS right_, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) + 0.0 AS below FROM embeddings a LEFT JOIN embeddings r ON a.vec_id % 10 < 9 AND r.vec_id = a.vec_id + 1 LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 10")
def _(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    right = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("r")).where("vec_id % 10 < 9 and vec_id >= 0")
    below = e.select((F.col("vec_id") - 10).alias("vec_id"), F.col("embedding").alias("b"))
    x = e.join(right, "vec_id", "left").join(below, "vec_id", "left")
    return x.select("vec_id", R4(cosine(F.col("embedding"), F.col("r"))).alias("right_"), R4(cosine(F.col("embedding"), F.col("b"))).alias("below"))


@query("G3_G4_edges", f"SELECT prev AS u, vec_id AS v, CASE WHEN sim >= {TAU} THEN 'temporal' ELSE 'event' END AS kind FROM ({_S}) WHERE sim >= {TAU} OR sim < 0")
def _(s, d):
    x = similar(s, d).where((F.col("sim") >= TAU) | (F.col("sim") < 0))
    return x.select(F.col("prev").alias("u"), F.col("vec_id").alias("v"), F.when(F.col("sim") >= TAU, "temporal").otherwise("event").alias("kind"))


_CC = f"""
WITH RECURSIVE e AS (SELECT prev AS u, vec_id AS v FROM ({_S}) WHERE sim >= {TAU}), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT u AS node, u AS other FROM b UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.other), c AS (SELECT node, min(other) AS component FROM r GROUP BY node)
"""


@query("G5_components", _CC + "SELECT node, component FROM c")
def _(s, d):
    return connected_components(edges(s, d))


@query("G7_threshold_clusters", _CC + "SELECT vec_id AS node, coalesce(component, vec_id) AS component FROM embeddings LEFT JOIN c ON node = vec_id")
def _(s, d):
    alone = table(s, d, "embeddings").select(F.col("vec_id").alias("u"), F.col("vec_id").alias("v"))
    return connected_components(edges(s, d).select("u", "v").unionByName(alone))


@query("G8_hierarchy", " UNION ALL ".join(f"(WITH RECURSIVE e AS (SELECT prev AS u, vec_id AS v FROM ({_S}) WHERE sim >= {t}), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r AS (SELECT u AS node, u AS other FROM b UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.other) SELECT {t}::DOUBLE AS level, count(DISTINCT low) AS clusters FROM (SELECT node, min(other) AS low FROM r GROUP BY node))" for t in (0.1, 0.2, 0.3)))
def _(s, d):
    out = None
    for t in (0.1, 0.2, 0.3):
        e = similar(s, d).where(F.col("sim") >= t).select(F.col("prev").alias("u"), F.col("vec_id").alias("v"))
        one = connected_components(e).agg(F.lit(t).alias("level"), F.countDistinct("component").alias("clusters"))
        out = one if out is None else out.unionByName(one)
    return out


@query("G18_cohesion", """WITH n AS (SELECT label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings), p AS (SELECT label, generate_subscripts(u, 1) AS k, unnest(u) AS x FROM n),
s AS (SELECT label, k, sum(x) AS x, count(*) AS n FROM p GROUP BY ALL) SELECT label, max(n) AS size, round((sum(x * x) - max(n)) / (max(n) * (max(n) - 1)), 4) + 0.0 AS cohesion FROM s GROUP BY label""")
def _(s, d):
    groups, _ = G.cohesion(table(s, d, "embeddings"), "label", "embedding", WIDTH)
    return groups.select("label", "size", R4("cohesion").alias("cohesion"))


@query("G19_centrality", """WITH n AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)
SELECT a.vec_id, round(avg(list_dot_product(a.u, b.u)), 4) + 0.0 AS centrality FROM n a JOIN n b ON a.label = b.label GROUP BY a.vec_id""")
def _(s, d):
    _, central = G.cohesion(table(s, d, "embeddings"), "label", "embedding", WIDTH)
    return central.select("vec_id", R4("centrality").alias("centrality"))


@query("G20_selection")
def _(s, d):
    x = similar(s, d)
    tokens = x.select(F.col("vec_id").alias("node"), F.col("embedding").alias("emb"))
    events = x.where((F.col("sim") > -2) & (F.col("sim") < 0)).select(F.col("vec_id").alias("node"))
    return G.select_tokens(tokens, edges(s, d).select("u", "v"), events, WIDTH, 0.7)


@query("G9_G10_communities")
def _(s, d):
    e = edges(s, d).join(table(s, d, "embeddings").select(F.col("vec_id").alias("v"), F.col("label").cast("long").alias("graph")), "v")
    return G.communities(e)


@query("G11_label_propagation")
def _(s, d):
    return G.label_propagation(edges(s, d))


@query("G14_pagerank")
def _(s, d):
    return G.pagerank(edges(s, d)).select("node", F.round("rank", 9).alias("rank"))


@query("G16_top_share", "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings) WHERE r <= floor(0.1 * n)")
def _(s, d):
    w = W.partitionBy("label")
    x = table(s, d, "embeddings").withColumn("r", F.row_number().over(w.orderBy(F.desc(F.col("embedding")[0]), "vec_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    return x.where(F.col("r") <= F.floor(0.1 * F.col("n"))).select("label", "vec_id")


@query("G21_block_sample", "SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY md5(vec_id::VARCHAR)) AS r FROM embeddings) WHERE r <= 3")
def _(s, d):
    w = W.partitionBy(F.floor(F.col("vec_id") / 10)).orderBy(F.md5(F.col("vec_id").cast("string")))
    return table(s, d, "embeddings").withColumn("r", F.row_number().over(w)).where("r <= 3").select("vec_id")


@query("G22_split_clusters", "SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR)) - 1) // 20 AS part FROM embeddings")
def _(s, d):
    w = W.partitionBy("label").orderBy(F.md5(F.col("vec_id").cast("string")))
    return table(s, d, "embeddings").select("vec_id", "label", F.floor((F.row_number().over(w) - 1) / 20).alias("part"))


@query("G23_k_centers")
def _(s, d):
    return G.k_centers(table(s, d, "embeddings"), 12)


@query("G24_concat", "SELECT vec_id, len(list_concat(embedding, embedding))::INT AS width FROM embeddings")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", F.size(F.concat("embedding", "embedding")).alias("width"))


@query("G25_subset", "SELECT vec_id FROM embeddings SEMI JOIN (SELECT vec_id FROM embeddings ORDER BY md5(vec_id::VARCHAR) LIMIT 50) USING (vec_id)")
def _(s, d):
    ids = table(s, d, "embeddings").select("vec_id").orderBy(F.md5(F.col("vec_id").cast("string"))).limit(50)
    return table(s, d, "embeddings").join(ids, "vec_id", "left_semi").select("vec_id")


@query("G27_retrieval", """WITH q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), r AS (SELECT q, v.vec_id, row_number() OVER (PARTITION BY q ORDER BY round(list_cosine_similarity(q.e, v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS r FROM q JOIN embeddings v ON v.vec_id <> q)
SELECT q, string_agg(vec_id::VARCHAR, ',' ORDER BY r) AS top FROM r WHERE r <= 8 GROUP BY q""")
def _(s, d):
    """The eight nearest rows of every hundredth one. Queries are a stated set; each keeps its best rows in partial aggregates."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qe"))
    scored = q.join(e, F.col("vec_id") != F.col("q")).select("q", "vec_id", F.round(cosine(F.col("qe"), F.col("embedding")), 9).alias("c"))
    best = scored.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("c"), "vec_id"))).where("r <= 8")
    return best.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "vec_id"))), lambda x: x["vec_id"].cast("string")), ",").alias("top"))
