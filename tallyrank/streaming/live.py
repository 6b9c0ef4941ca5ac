"""Live profiles as a table: events and the profiles that they change become visible by one commit.

A batch writes its events and the new profiles of its users to a folder of its own, in buckets of the user, and then
names the folder in the next numbered commit file, which is put in place by one atomic rename. A batch
whose id is committed already changes nothing, so a stream may deliver it again after a failure, and of two
writers the later one finds the number taken and folds anew. Reading takes each user's newest row; a batch
reads the buckets of its own users only.

A profile goes after a time without events, by the time of events, or by a commit that invalidates
some users or all; the next event starts from the trained profiles again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..files import Folder
from ..functions.weights import event_weight
from ..operators.content import fold_event
from ..session import checkpointed
from ..sources.schemas import EVENT, conform
from ..sources.store import valid_events
from .profiles import FOLDED

BUCKETS = 64
_BUCKET = T.StructField("bucket", T.IntegerType())
_PROFILE = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("fs", T.ArrayType(T.StringType())), T.StructField("vs", T.ArrayType(T.DoubleType())), T.StructField("n_events", T.LongType()), T.StructField("last", T.TimestampType()), _BUCKET])
_EVENTS = T.StructType([*EVENT.fields, _BUCKET])


def _bucket():
    return F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int")


class LiveProfiles:
    """features (product_id, feature, value) describe items; start (user_id, feature, value) is where users begin, from nothing by default.

    keep, such as "30 days", is how long a profile outlives its last event.
    """

    def __init__(self, spark: SparkSession, path: str, features: DataFrame, start: DataFrame | None = None, keep: str | None = None):
        self.spark, self.path, self.features, self.start = spark, path.rstrip("/"), features, start
        self.keep_us = None if keep is None else int(pd.Timedelta(keep).total_seconds() * 1_000_000)
        self._files = Folder(spark, self.path)
        self._seen: dict[str, dict] = {}

    def _commits(self) -> list[dict]:
        """In order, from the last compaction on; each file is read once."""
        names = self._files.names("commits")
        self._seen = {n: self._seen[n] if n in self._seen else json.loads(self._files.read(f"commits/{n}")) for n in names}
        found = [{"seq": int(n), **self._seen[n]} for n in names]
        base = max((c["seq"] for c in found if c["kind"] == "base"), default=0)
        return [c for c in found if c["seq"] >= base]

    def _commit(self, seq: int, **content) -> None:
        """FileExistsError if another writer took the number."""
        self._files.write(f"commits/{seq:012d}", json.dumps(content).encode(), replace=False)

    def _table(self, name: str, schema: T.StructType, commits: list[dict], buckets: list[int] | None) -> DataFrame:
        out = self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("seq", T.LongType())]))
        for c in commits:
            if c.get("folder"):
                rows = self.spark.read.schema(schema).parquet(f"{self.path}/{c['folder']}/{name}")
                if buckets is not None:
                    rows = rows.where(F.col("bucket").isin(buckets))
                out = out.unionByName(rows.withColumn("seq", F.lit(c["seq"]).cast("long")))
        return out

    def _newest(self, commits: list[dict], buckets: list[int] | None = None) -> DataFrame:
        """Each user's newest row that no later commit invalidates."""
        rows = self._table("profiles", _PROFILE, commits, buckets)
        newest = Window.partitionBy("user_id").orderBy(F.desc("seq"))
        rows = rows.withColumn("nth", F.row_number().over(newest)).where("nth = 1").drop("nth")
        all_gone = max((c["seq"] for c in commits if c["kind"] == "invalidate" and c["users"] is None), default=0)
        rows = rows.where(F.col("seq") > all_gone)
        gone = [(u, c["seq"]) for c in commits if c["kind"] == "invalidate" and c["users"] is not None for u in c["users"]]
        if gone:
            since = self.spark.createDataFrame(gone, "user_id string, gone long").groupBy("user_id").agg(F.max("gone").alias("gone"))
            rows = rows.join(since, "user_id", "left").where("gone is null or seq > gone").drop("gone")
        return rows

    def events(self) -> DataFrame:
        """All events of committed batches, each event_id of a user once."""
        return self._table("events", _EVENTS, self._commits(), None).select(*EVENT.names)

    def profiles(self, now: datetime | None = None) -> DataFrame:
        """(user_id, feature, value, n_events); with now, without profiles that have outlived keep by then."""
        rows = self._newest(self._commits())
        if now is not None and self.keep_us is not None:
            rows = rows.where(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("last") <= self.keep_us)
        return rows.select("user_id", F.explode(F.arrays_zip("fs", "vs")).alias("x"), "n_events").select("user_id", F.col("x.fs").alias("feature"), F.col("x.vs").alias("value"), "n_events")

    def apply(self, events: DataFrame, batch_id: str) -> bool:
        """Append a batch of events and fold it; False, and no change, if the batch is committed already.

        Events count in order of time, then id; those known by (user_id, event_id) count no more. Rows that
        lack a required column are left out. Views and items without features change no profile.
        """
        rows = checkpointed(valid_events(conform(events, EVENT, defaults=False)).dropDuplicates(["user_id", "event_id"]).withColumn("bucket", _bucket()))
        buckets = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS
        while True:
            commits = self._commits()
            if any(c.get("batch") == batch_id or batch_id in c.get("batches", ()) for c in commits):
                return False
            known = self._table("events", _EVENTS, commits, buckets).select("user_id", "event_id")
            fresh = checkpointed(rows.join(known, ["user_id", "event_id"], "left_anti").select(*EVENT.names, "bucket"))
            folder = f"batch-{uuid.uuid4().hex}"
            fresh.write.partitionBy("bucket").parquet(f"{self.path}/{folder}/events")
            self._folded(fresh, commits, buckets).write.partitionBy("bucket").parquet(f"{self.path}/{folder}/profiles")
            try:
                self._commit(commits[-1]["seq"] + 1 if commits else 1, kind="fold", batch=batch_id, folder=folder)
                return True
            except FileExistsError:
                self._files.remove(folder)

    def _folded(self, fresh: DataFrame, commits: list[dict], buckets: list[int]) -> DataFrame:
        """The new rows of users whose profile changes."""
        steps = fresh.where(F.col("event_type").isin(*FOLDED)).join(self.features.select("product_id").distinct(), "product_id", "left_semi")
        steps = steps.withColumn("weight", event_weight(F.col("event_type"), F.col("weight")))
        facts = checkpointed(steps.groupBy("user_id").agg(F.count("*").alias("new"), F.min("timestamp").alias("first"), F.max("timestamp").alias("latest")))
        held = checkpointed(self._newest(commits, buckets).join(facts, "user_id"))
        if self.keep_us is not None:
            held = held.where(F.unix_micros("first") - F.unix_micros("last") <= self.keep_us)
        long = held.select("user_id", F.explode(F.arrays_zip("fs", "vs")).alias("x")).select("user_id", F.col("x.fs").alias("feature"), F.col("x.vs").alias("value"))
        if self.start is not None:
            begin = self.start.join(facts.select("user_id"), "user_id", "left_semi").join(held.select("user_id"), "user_id", "left_anti")
            long = long.unionByName(begin.select("user_id", "feature", "value"))
        made = fold_event(long, self.features, steps).groupBy("user_id").agg(F.collect_list(F.struct("feature", "value")).alias("x"))
        counted = facts.join(held.select("user_id", F.col("n_events").alias("before"), F.col("last").alias("before_last")), "user_id", "left")
        out = made.join(counted, "user_id").select("user_id", F.col("x.feature").alias("fs"), F.col("x.value").alias("vs"), (F.coalesce("before", F.lit(0)) + F.col("new")).alias("n_events"), F.greatest("latest", "before_last").alias("last"))
        return out.withColumn("bucket", _bucket())

    def invalidate(self, user_ids: Iterable[str] | None = None) -> None:
        """Forget the profiles of these users, or of all; their events stay known."""
        users = None if user_ids is None else sorted(user_ids)
        while True:
            commits = self._commits()
            try:
                return self._commit(commits[-1]["seq"] + 1 if commits else 1, kind="invalidate", users=users)
            except FileExistsError:
                continue

    def compact(self) -> None:
        """One folder in place of all so far; what it replaces is removed, so no reader may still be at it."""
        commits = self._commits()
        if not commits:
            return
        folder = f"base-{uuid.uuid4().hex}"
        self._table("events", _EVENTS, commits, None).drop("seq").repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}/events")
        self._newest(commits).drop("seq").repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}/profiles")
        batches = sorted({b for c in commits for b in ([c["batch"]] if c.get("batch") else c.get("batches", []))})
        self._commit(commits[-1]["seq"] + 1, kind="base", folder=folder, batches=batches)
        for c in commits:
            if c.get("folder"):
                self._files.remove(c["folder"])
            self._files.remove(f"commits/{c['seq']:012d}")

    def stream(self, events: DataFrame, name: str, checkpoint: str, **trigger) -> StreamingQuery:
        """Apply a stream's micro-batches. name and batch number make a batch's id: one name for one checkpoint."""
        return events.writeStream.foreachBatch(lambda df, n: self.apply(df, f"{name}-{n}") and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
