"""The baseline that is the same for everyone but for what they have seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .interactions import item_popularity, seen_items
from .ranking import fallback_rows, rank_topk


def popularity_scores(cells: DataFrame, products: DataFrame) -> DataFrame:
    """(product_id, score) of the whole catalogue."""
    totals = item_popularity(cells)
    return products.select("product_id").distinct().join(totals, "product_id", "left").select("product_id", F.log1p(F.coalesce("total", F.lit(0.0))).alias("score"))


def recommend(cells: DataFrame, products: DataFrame, k: int, users: DataFrame | None = None) -> DataFrame:
    """Each user's best k of the common order without what they have seen.

    Only the first k plus the user's number of seen items can be among them.
    """
    seen = seen_items(cells)
    people = (users if users is not None else seen).select("user_id").distinct()
    many = seen.groupBy("user_id").agg(F.count("*").alias("n"))
    depth = people.join(many, "user_id", "left").select("user_id", (F.coalesce("n", F.lit(0)) + k).alias("depth"))
    return rank_topk(fallback_rows(depth, popularity_scores(cells, products), "depth"), k, exclude=seen)


def trending(cells: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    order = (F.desc(F.round("score", 9)), "product_id")
    best = popularity_scores(cells, products).orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows
