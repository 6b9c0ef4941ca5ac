"""Live profiles: a stream of events folded into per-user state, exactly once per event id."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.weights import event_weight
from ..operators.content import folded
from ..sources.schemas import EVENT

#: Types that change a profile; views don't.
FOLDED = ("add_to_cart", "purchase", "rating", "wishlist")
OUTPUT = "user_id string, feature string, value double, n_events long"
_STATE = "fs array<string>, vs array<double>, n long"


def event_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """New files of a folder of event tables."""
    return spark.readStream.schema(EVENT).options(**options).parquet(path)


def live_events(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Events that fold, with their weight; each event_id once within the watermark."""
    known = stream.where(F.col("event_type").isin(*FOLDED)).withColumn("weight", event_weight(F.col("event_type"), F.col("weight")))
    return known.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["event_id"])


def profile_stream(events: DataFrame, features: DataFrame, profiles: DataFrame | None = None, idle: str | None = None) -> DataFrame:
    """After each micro-batch the new profiles of the users in it, as (user_id, feature, value, n_events).

    A user's state is its profile: as many numbers as its features. Within a batch events
    count in order of time, then id. profiles (user_id, feature, value) are where users
    start; both static sides are read anew for each batch. Events of items without features
    change nothing. With idle (such as "30 days") the state of a user without events for so long, by the
    watermark, goes; a later event starts from profiles again, which should hold what the stream wrote.
    """
    idle_ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    items = features.groupBy("product_id").agg(F.collect_list("feature").alias("fs"), F.collect_list("value").alias("vs"))
    rows = events.join(items, "product_id").select("user_id", "timestamp", "event_id", "weight", "fs", "vs")
    if profiles is not None:
        start = profiles.groupBy("user_id").agg(F.collect_list("feature").alias("start_fs"), F.collect_list("value").alias("start_vs"))
        rows = rows.join(start, "user_id", "left")
    else:
        rows = rows.select("*", F.array().cast("array<string>").alias("start_fs"), F.array().cast("array<double>").alias("start_vs"))

    def fold(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["timestamp", "event_id"])
        if state.exists:
            fs, vs, n = state.get
        else:
            fs, vs, n = rows["start_fs"].iloc[0], rows["start_vs"].iloc[0], 0
            fs, vs = (fs, vs) if fs is not None else ([], [])
        steps = [(w, dict(zip(f, v, strict=True))) for w, f, v in zip(rows["weight"], rows["fs"], rows["vs"], strict=True)]
        out = folded(dict(zip(fs, vs, strict=True)), steps)
        state.update((list(out), [float(x) for x in out.values()], int(n) + len(rows)))
        if idle_ms is not None:
            # Never at or before the watermark, which a timeout must lie beyond.
            latest = int(rows["timestamp"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"user_id": key[0], "feature": list(out), "value": list(out.values()), "n_events": int(n) + len(rows)})

    return rows.groupBy("user_id").applyInPandasWithState(fold, OUTPUT, _STATE, "update", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout)


def windowed_counts(stream: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """(start, event_type, n, weight) per window of event time; late events within the watermark count."""
    timed = stream.withWatermark("timestamp", watermark).withColumn("weight", event_weight(F.col("event_type"), F.col("weight")))
    return timed.groupBy(F.window("timestamp", window), "event_type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).select("window.start", "event_type", "n", "weight")
