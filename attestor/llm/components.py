"""Connected components of a graph given by its edges, without bringing any of it to the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, for nodes 0..n-1 and edges (u, v)."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def connected(edges: DataFrame) -> DataFrame:
    """Rows (node, root): each node that has an edge and the smallest node of its component.

    ``edges`` has ``u`` and ``v``. Stars are rewired by turns: every node links its larger neighbours,
    then itself and its smaller neighbours, to the least of them, until nothing changes. A node with
    many neighbours is met by an aggregate with partial results and by a join whose large partitions
    can be split. Each round is written to the shared folder.
    """
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        kept = both.where("v < u").groupBy("u").agg(F.min("v").alias("low"))  # nodes without larger neighbours keep their link
        large = written(large.unionByName(kept.select("u", F.col("low").alias("v"))).where("u != v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = written(small.unionByName(low.select("u", F.col("low").alias("v"))).where("u != v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
