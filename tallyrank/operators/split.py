"""A per-user temporal split that leaks nothing from what is held out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from ..sources.schemas import POSITIVE_EVENTS

# The bounds of the segments in training events.
COLD_MAX = 25
WARM_MIN = 60


@dataclass(frozen=True)
class TemporalSplit:
    train: DataFrame
    val: DataFrame
    test: DataFrame
    train_counts: DataFrame

    def truth(self, target: str = "test") -> DataFrame:
        """(user_id, product_id), each pair once."""
        return {"val": self.val, "test": self.test}[target].select("user_id", "product_id").distinct()


def temporal_split(events: DataFrame, holdout: int = 5, val_size: int = 2, positive_only: bool = True, min_train: int = 5) -> TemporalSplit:
    """Each user's last events are held out: the older val_size to val, the rest to test.

    Training keeps what lies strictly before a user's first held-out event; users without one
    are kept whole, users with under min_train training events not at all. Held-out pairs
    that training has seen go. Equal times are ordered by event_id. The parts are stored as one table.
    """
    by_user = Window.partitionBy("user_id")
    newest = by_user.orderBy(F.desc("timestamp"), F.desc("event_id"))
    counts = F.coalesce(F.col("event_type").isin(*POSITIVE_EVENTS), F.lit(False)) if positive_only else F.lit(True)
    # All windows are within a user, so the events move once, however many parts are read from them.
    rows = events.where("user_id is not null").withColumn("__counts", counts)
    rows = rows.withColumn("__last", F.when(F.col("__counts"), F.sum(F.col("__counts").cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, 0))))
    rows = rows.withColumn("__held", F.coalesce(F.col("__last") <= holdout, F.lit(False)))
    cutoff = F.min(F.when(F.col("__held"), F.col("timestamp"))).over(by_user)
    rows = rows.withColumn("__cutoff", cutoff).withColumn("__n_held", F.count_if("__held").over(by_user))
    rows = rows.withColumn("__train", F.coalesce(F.col("__cutoff").isNull() | (F.col("timestamp") < F.col("__cutoff")), F.lit(False)))
    rows = rows.withColumn("__n_train", F.count_if("__train").over(by_user)).where(F.col("__n_train") >= min_train)
    known = F.max("__train").over(Window.partitionBy("user_id", "product_id")) & F.col("product_id").isNotNull()
    rows = rows.withColumn("__fresh", F.col("__held") & ~known).withColumn("__first", F.col("__n_held") - F.col("__last") + 1).where("__train or __fresh")
    columns = events.columns
    parts = checkpointed(rows.select(*columns, "__train", "__fresh", "__first"))
    train, fresh = parts.where("__train").select(*columns), parts.where("__fresh")
    train_counts = train.groupBy("user_id").agg(F.count("*").alias("n_train"))
    return TemporalSplit(train, fresh.where(F.col("__first") <= val_size).select(*columns), fresh.where(F.col("__first") > val_size).select(*columns), train_counts)


def segments(train_counts: DataFrame) -> DataFrame:
    """(segment, user_id): all, cold_start and warm overlap; users between are in all only."""
    names = F.array_compact(F.array(F.lit("all"), F.when(F.col("n_train") <= COLD_MAX, F.lit("cold_start")), F.when(F.col("n_train") >= WARM_MIN, F.lit("warm"))))
    return train_counts.select(F.explode(names).alias("segment"), "user_id")
