"""Connected components by alternating large and small stars; every round is a few grouped minima and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut


def _minima(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node that can be reached.

    Nodes are of one orderable type. Null ends and loops are left out; repeated edges change nothing; no edges give no rows.
    Each step is written to the shared folder, so plans stay short, a lost executor costs one step at most, and the joins are
    of written tables: Spark broadcasts a small one by its size and splits a node with most edges where it is skewed.
    """
    now = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = cut(now)
    while True:
        # Large star: of u's neighbours those above u move to the least neighbour.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(both.join(cut(_minima(both)), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: u and its neighbours below move to the least of them. Now v < u holds for every pair.
        least = cut(_minima(large))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        # A forest of stars: no centre hangs on another node, no node on two centres.
        if now.groupBy("u").count().where("count > 1").isEmpty() and now.join(now.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
