"""Events folded into a sparse user by item table of decayed, damped confidences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.weights import event_weight, recency_decay
from ..sources.schemas import POSITIVE_EVENTS


def positive_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(*POSITIVE_EVENTS))


def interaction_matrix(events: DataFrame, products: DataFrame | None = None, users: DataFrame | None = None, halflife_days: float = 30.0, positive_only: bool = False, reference=None) -> DataFrame:
    """(user_id, product_id, value) of every positive cell.

    value is log1p of the sum of weight times decay. Ages count from reference, or the
    latest event left. products and users restrict the cells, not the reference.
    """
    rows = positive_events(events) if positive_only else events
    rows = rows.select("user_id", "product_id", "event_type", "timestamp", "weight")
    if reference is None:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.max("timestamp").alias("reference"))))  # one row
    else:
        rows = rows.withColumn("reference", F.lit(reference).cast("timestamp"))
    worth = event_weight(F.col("event_type"), F.col("weight")) * recency_decay(F.col("timestamp"), F.col("reference"), halflife_days)
    cells = rows.groupBy("user_id", "product_id").agg(F.sum(worth).alias("value")).where("value > 0")
    if products is not None:
        cells = cells.join(products.select("product_id").distinct(), "product_id", "left_semi")
    if users is not None:
        cells = cells.join(users.select("user_id").distinct(), "user_id", "left_semi")
    return cells.select("user_id", "product_id", F.log1p("value").alias("value"))


def interaction_frame(events: DataFrame, products: DataFrame | None = None, users: DataFrame | None = None, halflife_days: float = 30.0, positive_only: bool = False, reference=None) -> DataFrame:
    """interaction_matrix() beside how it was made: (user_id, product_id, value, halflife_days, reference_time)."""
    cells = interaction_matrix(events, products, users, halflife_days, positive_only, reference)
    rows = positive_events(events) if positive_only else events
    when = F.lit(reference).cast("timestamp") if reference is not None else F.max("timestamp")
    made = rows.agg(when.alias("reference_time")) if reference is None else rows.sparkSession.range(1).select(when.alias("reference_time"))
    return cells.crossJoin(F.broadcast(made)).select("user_id", "product_id", "value", F.lit(float(halflife_days)).alias("halflife_days"), "reference_time")  # one row


def seen_items(cells: DataFrame) -> DataFrame:
    return cells.select("user_id", "product_id").distinct()


def item_popularity(cells: DataFrame) -> DataFrame:
    return cells.groupBy("product_id").agg(F.sum("value").alias("total"))


def popularity_share(cells: DataFrame) -> DataFrame:
    """(product_id, share) of the total of all items."""
    totals = item_popularity(cells)
    whole = totals.agg(F.sum("total").alias("whole"))
    return totals.crossJoin(F.broadcast(whole)).select("product_id", F.when(F.col("whole") > 0, F.col("total") / F.col("whole")).otherwise(0.0).alias("share"))  # one row


def minmax_per_user(scores: DataFrame, column: str = "score") -> DataFrame:
    """column scaled to 0..1 within each user; where all are equal, 0."""
    of_user = Window.partitionBy("user_id")
    low, high = F.min(column).over(of_user), F.max(column).over(of_user)
    return scores.withColumn(column, F.when(high - low > 1e-12, (F.col(column) - low) / (high - low)).otherwise(0.0))


def profile_window(cells: DataFrame, size: int = 10) -> DataFrame:
    """Each user's strongest cells; equals by product_id."""
    order = Window.partitionBy("user_id").orderBy(F.desc(F.round("value", 9)), "product_id")
    return cells.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= size)
