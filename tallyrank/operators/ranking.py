"""Ranked lists: a total order, exclusions, and padding of sparse scores.

Scores rank by their value rounded to nine places, then by product_id, so that engines which
add in another order agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def order_of(*partition: str, score: str = "score"):
    return Window.partitionBy(*partition).orderBy(F.desc(F.round(score, 9)), "product_id")


def rank_topk(scores: DataFrame, k: int, exclude: DataFrame | None = None, candidates: DataFrame | None = None, include_seen: bool = False) -> DataFrame:
    """(user_id, product_id, score, rank): each user's best k.

    exclude holds (user_id, product_id) pairs, candidates product_ids. include_seen turns
    exclude off as a whole.
    """
    rows = scores.select("user_id", "product_id", "score")
    if exclude is not None and not include_seen:
        rows = rows.join(exclude.select("user_id", "product_id").distinct(), ["user_id", "product_id"], "left_anti")
    if candidates is not None:
        rows = rows.join(candidates.select("product_id").distinct(), "product_id", "left_semi")
    ranked = rows.withColumn("rank", F.row_number().over(order_of("user_id")))
    return ranked.where(F.col("rank") <= k).select("user_id", "product_id", "score", "rank")


def numbered(items: DataFrame) -> DataFrame:
    """(product_id, score, place) of items ordered by score, then id, from 1.

    Sorted by ranges; places are counted within a range and moved up by what lies before,
    so no task sees the whole catalogue.
    """
    parts = items.select("product_id", F.col("score")).repartitionByRange(F.desc(F.round("score", 9)), F.col("product_id")).select("*", F.spark_partition_id().alias("part"))
    parts = checkpointed(parts)  # read twice; ranges must not be drawn anew
    inner = parts.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(F.desc(F.round("score", 9)), "product_id")))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    return inner.join(F.broadcast(before), "part").select("product_id", "score", (F.col("nth") + F.col("before")).cast("int").alias("place"))


def fallback_rows(users: DataFrame, items: DataFrame, depth: str) -> DataFrame:
    """(user_id, product_id, score): each user's first so many items of the common order.

    users has user_id and the column depth. Rows are as many as the depths add up to.
    """
    place = users.where(F.col(depth) > 0).select("user_id", F.explode(F.sequence(F.lit(1), F.col(depth).cast("int"))).alias("place"))
    return place.join(numbered(items), "place").select("user_id", "product_id", "score")


def padded(scores: DataFrame, users: DataFrame, items: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """scores with zeros for items that they lack, as many as a ranking of k can reach.

    The unscored items of a user rank by id. Those that matter are among the first k plus
    the number of items which the user has scored or seen; no user meets the whole catalogue.
    """
    touched = scores.select("user_id", "product_id").unionByName(seen.select("user_id", "product_id")).distinct()
    depth = users.select("user_id").distinct().join(touched.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left").select("user_id", (F.coalesce("n", F.lit(0)) + k).alias("depth"))
    zeros = fallback_rows(depth, items.select("product_id", F.lit(0.0).alias("score")), "depth")
    both = scores.select("user_id", "product_id", "score").unionByName(zeros)
    return both.groupBy("user_id", "product_id").agg(F.sum("score").alias("score"))
