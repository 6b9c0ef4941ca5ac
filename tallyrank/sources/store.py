"""A store of products, users and events as Parquet tables.

Products and users are replaced by key. They lie in buckets of the key; an upsert writes its own rows
as a delta beside the version, in the buckets that they touch, and then names it in the table's pointer, so
readers see the old or the new table and never a mix. Reading takes each key's newest row. After MAX_DELTAS the next
upsert rewrites the version. Events are appended and read once per event_id.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..files import Folder
from .schemas import EVENT, PRODUCT, REQUIRED_EVENT_COLUMNS, USER, conform

SCHEMAS = {"products": PRODUCT, "users": USER, "events": EVENT}
#: Files a day of events at most, by user.
EVENT_FILES = 16
#: Buckets of a keyed table, and deltas beside a version before an upsert merges them.
BUCKETS = 64
MAX_DELTAS = 16
KEYS = {"products": "product_id", "users": "user_id", "events": "event_id"}


def latest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with the same key; among rows of new the largest."""
    columns = old.columns
    both = old.withColumn("__new", F.lit(0)).unionByName(new.select(*columns).withColumn("__new", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.desc("__new"), *(F.desc(c) for c in columns if c != key))
    return both.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__new", "__nth")


def valid_events(events: DataFrame) -> DataFrame:
    return events.dropna(subset=list(REQUIRED_EVENT_COLUMNS))


def events_since(events: DataFrame, since=None, user_id: str | None = None) -> DataFrame:
    """Oldest first per user; since is inclusive."""
    if since is not None:
        events = events.where(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    if user_id is not None:
        events = events.where(F.col("user_id") == user_id)
    return ordered(events)


def ordered(events: DataFrame) -> DataFrame:
    """Each event once (an event_id of a user and time), by user, time and id: one shuffle by ranges of user and time.

    Ranges cut a long history by time, so no user's events have to meet in one task.
    """
    ranged = events.repartitionByRange("user_id", "timestamp")
    return ranged.dropDuplicates(["user_id", "timestamp", "event_id"]).sortWithinPartitions("user_id", "timestamp", "event_id")


def user_product_rollup(events: DataFrame, user_ids: list[str] | None = None) -> DataFrame:
    """Per user and product: the sum of weights (a null weighs 1), the events and the latest time."""
    if user_ids is not None:
        events = events.where(F.col("user_id").isin(user_ids))
    return events.groupBy("user_id", "product_id").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"), F.count("*").alias("n_events"), F.max("timestamp").alias("last_ts"))


def table_counts(products: DataFrame, users: DataFrame, events: DataFrame) -> DataFrame:
    """(table_name, n_rows): one scan each, no rows brought together."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in (("products", products), ("users", users), ("events", events))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


@dataclass
class Store:
    """Tables under a path.

    Events lie in one folder per day of their timestamp and are sorted by user and time within files, so that
    since reads the days it needs and user_id skips row groups. Appends add files; compact()
    rewrites them as few large ones and moves the pointer.
    """

    spark: SparkSession
    path: str

    @property
    def _files(self) -> Folder:
        return Folder(self.spark, self.path)

    def _pointer(self, name: str) -> dict | None:
        """{version, deltas}: the folder of the whole table and those of later upserts, oldest first."""
        found = self._files.read(f"{name}/CURRENT")
        return json.loads(found) if found else None

    def _folder(self, name: str) -> str | None:
        pointer = self._pointer(name)
        return f"{self.path}/{name}/{pointer['version']}" if pointer else None

    def _read(self, name: str, keys: list[str] | None = None) -> DataFrame:
        """The table's rows; of products and users with keys only those, from their buckets alone."""
        pointer, schema = self._pointer(name), SCHEMAS[name]
        if pointer is None:
            return self.spark.createDataFrame([], schema)
        laid = T.StructType([*schema.fields, T.StructField("day", T.DateType()) if name == "events" else T.StructField("bucket", T.IntegerType())])
        parts = [self.spark.read.schema(laid).parquet(f"{self.path}/{name}/{v}") for v in (pointer["version"], *pointer["deltas"])]
        if name == "events":
            return parts[0]
        key = KEYS[name]
        if keys is not None:
            asked = sorted({r.b for r in self.spark.createDataFrame([(k,) for k in keys], f"{key} string").select(_bucket(key).alias("b")).collect()})
            parts = [p.where(F.col("bucket").isin(asked) & F.col(key).isin(keys)) for p in parts]
        out = parts[0].drop("bucket")
        if len(parts) == 1:
            return out
        aged = [p.drop("bucket").withColumn("__age", F.lit(n)) for n, p in enumerate(parts)]
        newest = Window.partitionBy(key).orderBy(F.desc("__age"))
        rows = reduce(DataFrame.unionByName, aged).withColumn("__nth", F.row_number().over(newest))
        return rows.where("__nth = 1").drop("__age", "__nth")

    @staticmethod
    def _laid(name: str, df: DataFrame):
        if name != "events":
            return df.withColumn("bucket", _bucket(KEYS[name])).repartition("bucket").write.partitionBy("bucket")
        dated = df.select(*EVENT.names, F.to_date("timestamp").alias("day"))
        return dated.repartition("day", F.pmod(F.xxhash64("user_id"), F.lit(EVENT_FILES))).sortWithinPartitions("day", "user_id", "timestamp").write.partitionBy("day")

    def _replace(self, name: str, df: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        self._laid(name, df).parquet(f"{self.path}/{name}/{version}")
        self._point(name, version, [])

    def _point(self, name: str, version: str, deltas: list[str]) -> None:
        self._files.write(f"{name}/CURRENT", json.dumps({"version": version, "deltas": deltas}).encode())

    def _upsert(self, name: str, rows: DataFrame) -> None:
        """One writer of a table at a time. Of rows with one key the largest counts."""
        key, pointer = KEYS[name], self._pointer(name)
        if pointer is None or len(pointer["deltas"]) >= MAX_DELTAS:
            self._replace(name, latest(self._read(name), rows, key))
            return
        delta = f"d-{uuid.uuid4().hex}"
        self._laid(name, latest(rows.limit(0), rows, key)).parquet(f"{self.path}/{name}/{delta}")
        self._point(name, pointer["version"], [*pointer["deltas"], delta])

    def upsert_products(self, products: DataFrame) -> None:
        self._upsert("products", conform(products, PRODUCT))

    def upsert_users(self, users: DataFrame) -> None:
        self._upsert("users", conform(users, USER))

    def product(self, product_id: str) -> DataFrame:
        """The product's row, or none, from its bucket alone."""
        return self._read("products", [product_id])

    def insert_events(self, events: DataFrame) -> None:
        folder = self._folder("events")
        rows = valid_events(conform(events, EVENT, defaults=False))
        if folder is None:
            self._replace("events", rows)
        else:
            self._laid("events", rows).mode("append").parquet(folder)

    append_event = insert_events

    def compact(self) -> None:
        """Rewrite the events, each event_id once, and tables with deltas. One writer at a time; readers keep the old version."""
        for name in ("products", "users"):
            if (pointer := self._pointer(name)) and pointer["deltas"]:
                self._replace(name, self._read(name))
        if self._folder("events"):
            self._replace("events", self._read("events").drop("day").dropDuplicates(["event_id"]))

    def products(self) -> DataFrame:
        """In order of product_id."""
        return self._read("products").orderBy("product_id")

    def users(self) -> DataFrame:
        return self._read("users")

    def events(self, since=None, user_id: str | None = None) -> DataFrame:
        rows = self._read("events")
        if since is not None and "day" in rows.columns:
            rows = rows.where(F.col("day") >= F.date_sub(F.to_date(F.lit(since).cast("timestamp")), 1))  # prunes folders; a day more, as days depend on the time zone
        return events_since(rows.drop("day"), since, user_id)

    def user_profile_counts(self, user_ids: list[str] | None = None) -> DataFrame:
        return user_product_rollup(self._read("events").drop("day").dropDuplicates(["event_id"]), user_ids).orderBy("user_id", "last_ts", "product_id")

    def counts(self) -> dict[str, int]:
        return {r.table_name: r.n_rows for r in table_counts(self._read("products"), self._read("users"), self._read("events").dropDuplicates(["event_id"])).collect()}

    def clear(self) -> None:
        for name, schema in SCHEMAS.items():
            self._replace(name, self.spark.createDataFrame([], schema))
