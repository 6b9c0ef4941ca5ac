"""Connected components of a link table, by alternating stars.

Each round is two aggregations and two joins; no adjacency list is ever gathered, so
a hub with any number of neighbours costs a partial minimum and rows that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ROUNDS = 60


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link each node's neighbours to the smallest of its closed neighbourhood.

    small: look at smaller neighbours only and link them, and the node itself; else
    link the larger neighbours. Both keep what is connected.
    """
    seen = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = seen.join(least, "u")
    if small:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
    else:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u > v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v); root is the smallest node reachable.

    Self links and repeats do no harm; an empty link table gives an empty result.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "links")
    before = None
    for _ in range(ROUNDS):
        now = stored(_star(stored(_star(now, False), "large-star"), True), "small-star")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
