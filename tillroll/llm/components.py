"""Connected components of a list of links."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.staging import stage


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links to the smallest member of each component of links among 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    members = np.flatnonzero(root != np.arange(n))
    return root[members], members


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for every node of the links a, b.

    Alternates two steps until nothing changes: every node sends its larger neighbours to its
    smallest one, then its smaller neighbours.  The number of links never grows, and the longest way
    halves, so a chain of n nodes takes about log n rounds.  Each round is a map-side combined
    minimum and a join on the node, written to the shared folder, where a lost executor finds it again.
    """
    edges = stage(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links"
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = stage(small.filter("u > v").distinct(), "links")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
