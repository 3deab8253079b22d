"""Connected components of a graph in a DataFrame, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame) -> DataFrame:
    """(v, m) for every edge (u, v), with m the smallest of u and all its neighbours in ``edges``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").bitwiseXOR(F.lit(0).cast("long")).alias("w"), F.least("u", "m").alias("m"))
    # w is a fresh expression, so both sides get an exchange of their own and AQE can split a hub's edges over tasks
    return edges.join(least, edges["u"] == least["w"]).select("u", "v", "m")


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u and v, long): root is the smallest node reachable.

    Edges with a null end and loops count for nothing (a node that only has such edges gets no row). Repeated edges and
    an empty table are fine. Each round is written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    pairs = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    now = written(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        small = _star(large)  # here v < u always
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = written(small, "small")
        # done when every node has one edge, to a node that has none upwards
        now = small
        forks = small.groupBy("u").count().where("count > 1").select("u")
        chains = small.select(F.col("v").bitwiseXOR(F.lit(0).cast("long")).alias("u")).distinct().join(small.select("u"), "u", "left_semi")
        if forks.unionByName(chains).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(members.select(F.col("root").alias("node"), "root").distinct())
