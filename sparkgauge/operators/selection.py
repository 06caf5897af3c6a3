"""Token selection: similarity edges, components, cohesion, budgets and representatives."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkgauge.checkpoints import cut
from sparkgauge.functions.vector import cosine, dot, unit, vector_sum
from sparkgauge.operators.graph import connected_components


def lagged(df: DataFrame, keys: list[str], order: str, vector: str, k: int = 1) -> DataFrame:
    """``sim``: cosine with the k-th row before; null for the first rows."""
    return df.withColumn("sim", cosine(F.col(vector), F.lag(vector, k).over(W.partitionBy(*keys).orderBy(order))))


def cohesion(members: DataFrame, group: str, vector: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(mean off-diagonal cosine and size of each group, centrality of each member).

    Both come from the sum of the unit vectors, so no pairs are formed.
    """
    u = members.withColumn("__u", unit(F.col(vector)))
    total = u.groupBy(group).agg(vector_sum(F.col("__u"), width).alias("__s"), F.count("__u").alias("size"))
    norm = dot(F.col("__s"), F.col("__s"))
    groups = total.select(group, "size", F.try_divide(norm - F.col("size"), (F.col("size") * (F.col("size") - 1)).cast("double")).alias("cohesion"))
    central = u.join(total, group).withColumn("centrality", dot(F.col("__u"), F.col("__s")) / F.col("size")).drop("__u", "__s", "size")
    return groups, central


def select_tokens(tokens: DataFrame, edges: DataFrame, events: DataFrame, width: int, bound: float) -> DataFrame:
    """The budgeted selection: ``node`` and ``dropped`` for every token.

    tokens (node, emb), edges (u, v), events (node). Components go by falling cohesion; of
    each, the ceil(size * bound) least central tokens are dropped unless they are events,
    until a component would take the share of dropped tokens over ``bound``.
    """
    comp = connected_components(edges).where(F.col("node").isNotNull())
    members = cut(tokens.join(comp, "node"))
    groups, central = cohesion(members, "component", "emb", width)
    ranked = central.join(groups.select("component", F.ceil(F.col("size") * bound).alias("m")), "component").join(events.withColumn("event", F.lit(1)), "node", "left")
    last = W.partitionBy("component").orderBy("centrality", F.desc("node"))
    picked = ranked.withColumn("away", (F.row_number().over(last) <= F.col("m")) & F.col("event").isNull())
    loss = picked.groupBy("component").agg(F.sum(F.col("away").cast("int")).alias("loss"), F.first("m").alias("m")).join(groups, "component")
    total = tokens.count()
    # running totals over one narrow row a component; nothing is gathered in one row
    ranked_ = W.orderBy((-F.col("cohesion")).asc(), "component")
    before = F.coalesce(F.sum("loss").over(ranked_.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    over = loss.select("component", ((before + F.col("m")) / float(max(total, 1)) > bound).alias("over"), "cohesion")
    taken = over.withColumn("stop", F.max("over").over(ranked_.rowsBetween(W.unboundedPreceding, 0))).where("not stop").select("component")
    gone = picked.where("away").join(taken, "component").select("node", F.lit(True).alias("gone"))
    return tokens.select("node").join(gone, "node", "left").select("node", F.coalesce("gone", F.lit(False)).alias("dropped"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) by power iteration on an undirected weighted edge table (u, v, w)."""
    both = edges.select("u", "v", "w").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    out = both.groupBy("u").agg(F.sum("w").alias("total"))
    share = cut(both.join(out, "u").select("u", "v", (F.col("w") / F.col("total")).alias("p")))
    nodes = cut(out.select(F.col("u").alias("node")))
    n = max(nodes.count(), 1)
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        flow = share.join(rank, F.col("u") == F.col("node")).groupBy(F.col("v").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("in"))
        rank = cut(nodes.join(flow, "node", "left").select("node", ((1 - damping) / n + damping * F.coalesce("in", F.lit(0.0))).alias("rank")))
    return rank


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, label): every node takes its neighbours' most frequent label, of several the smallest, all at once."""
    both = cut(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = both.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        seen = both.join(label, F.col("v") == F.col("node")).groupBy("u", "label").agg(F.count(F.lit(1)).alias("n"))
        label = cut(seen.groupBy(F.col("u").alias("node")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label")))
    return label


def k_centers(vectors: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Greedy k-center from the smallest id: each round takes the row farthest from all centers (ties: smallest id)."""
    far = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).withColumn("d", F.lit(float("inf")))
    chosen = []
    center = far.orderBy("id").first()
    while center is not None and len(chosen) < k:
        chosen.append((len(chosen), center.id))
        here = F.array(*map(F.lit, center.v))
        diff = F.zip_with("v", here, lambda a, b: a - b)
        far = far.withColumn("d", F.least("d", F.sqrt(dot(diff, diff))))
        if len(chosen) % 8 == 0:
            far = cut(far)
        center = far.agg(F.max_by(F.struct("id", "v"), F.struct("d", -F.col("id"))).alias("c"), F.max("d").alias("d")).first()
        center = center.c if center.d else None
    return vectors.sparkSession.createDataFrame(chosen, "rank int, id long")


def communities(edges: DataFrame, graph: str = "graph", resolution: float = 1.0) -> DataFrame:
    """(graph, node, community) by one level of local moves on modularity, for each graph on its own.

    Nodes move in the order of their ids to the neighbouring community of the largest gain
    until none moves. A graph must fit one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for u, v, w in zip(pdf["u"], pdf["v"], pdf["w"], strict=True):
            if u != v:
                near.setdefault(u, {})[v] = near.get(u, {}).get(v, 0.0) + w
                near.setdefault(v, {})[u] = near.get(v, {}).get(u, 0.0) + w
        degree = {u: sum(x.values()) for u, x in near.items()}
        two_m = sum(degree.values()) or 1.0
        com, total = {u: u for u in near}, dict(degree)
        for _ in range(100):
            moved = False
            for u in sorted(near):
                own = com[u]
                total[own] -= degree[u]
                links: dict = {own: 0.0}
                for v, w in near[u].items():
                    links[com[v]] = links.get(com[v], 0.0) + w
                best = max(links, key=lambda c: (round(links[c] - resolution * degree[u] * total[c] / two_m, 12), c == own, -c))
                total[best] += degree[u]
                com[u], moved = best, moved or best != own
            if not moved:
                break
        return pd.DataFrame({"graph": pdf["graph"].iloc[0], "node": list(com), "community": list(com.values())})

    return edges.select(F.col(graph).alias("graph"), "u", "v", "w").groupBy("graph").applyInPandas(run, "graph long, node long, community long")
