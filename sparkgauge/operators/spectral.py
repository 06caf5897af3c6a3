"""Spectral clustering of weighted graphs, one graph a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_edges(edges: DataFrame, k: int, graph: str = "graph") -> DataFrame:
    """(graph, u, v, w) with u < v: the ``k`` heaviest edges of every node (ties: smallest neighbour), from either end."""
    clean = edges.where("u <> v").groupBy(F.col(graph).alias("graph"), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("w").alias("w"))
    both = clean.unionByName(clean.select("graph", F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    rank = F.row_number().over(Window.partitionBy("graph", "u").orderBy(F.desc("w"), "v"))
    kept = both.withColumn("rank", rank).where(F.col("rank") <= k)
    return kept.select("graph", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").distinct()


def k_means(points: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Cluster of each point; the first center is the first point, each next one the point farthest from all centers."""
    centers = [points[0]]
    while len(centers) < min(k, len(points)):
        far = np.min([((points - c) ** 2).sum(1) for c in centers], axis=0)
        centers.append(points[int(np.argmax(np.round(far, 12)))])
    centers = np.array(centers)
    for _ in range(rounds):
        own = np.argmin(((points[:, None] - centers[None]) ** 2).sum(2), axis=1)
        new = np.array([points[own == c].mean(0) if (own == c).any() else centers[c] for c in range(len(centers))])
        if np.allclose(new, centers, atol=1e-6):
            break
        centers = new
    return own


def spectral(edges: DataFrame, k: int, graph: str = "graph", normalised: bool = False) -> DataFrame:
    """(graph, node, cluster): k-means on the eigenvectors of the ``k`` least eigenvalues of the Laplacian.

    The plain Laplacian is degree minus weights; ``normalised`` is the symmetric one, with
    rows scaled to length 1. A cluster is named by its smallest node. A graph must fit one
    task; graphs of at most ``k`` nodes get a cluster a node.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.concatenate([pdf["u"], pdf["v"]]))
        u, v = np.searchsorted(nodes, pdf["u"]), np.searchsorted(nodes, pdf["v"])
        w = np.zeros((len(nodes), len(nodes)))
        w[u, v] = w[v, u] = pdf["w"]
        np.fill_diagonal(w, 0)
        degree = w.sum(1)
        if normalised:
            root = 1 / np.sqrt(np.where(degree > 0, degree, 1))
            laplacian = np.eye(len(nodes)) - root[:, None] * w * root
        else:
            laplacian = np.diag(degree) - w
        points = np.linalg.eigh(laplacian)[1][:, :k]
        if normalised:
            points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
        own = k_means(points, k) if len(nodes) > k else np.arange(len(nodes))
        low = {c: nodes[own == c].min() for c in set(own)}
        return pd.DataFrame({"graph": pdf["graph"].iloc[0], "node": nodes, "cluster": [low[c] for c in own]})

    return edges.select(F.col(graph).alias("graph"), "u", "v", F.col("w").cast("double")).groupBy("graph").applyInPandas(run, "graph long, node long, cluster long")
