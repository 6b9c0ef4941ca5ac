"""The entities read from star-schema tables.

dense_events: the events table; a hundred products, many events a user.
visitor_events: events of visitors whose identity ends with a long silence; short and long histories.
star_events: orders with their lines; sparse, many ties, users with little history.
catalogue: parts as products. people: customers as users.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TYPES = {"view": "view", "click": "add_to_cart", "signup": "wishlist", "purchase": "purchase"}
#: A visitor who was silent for so long is not known again.
SILENCE_HOURS = 48
_FLAGS = {"A": "purchase", "R": "add_to_cart"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(letter: str, number: Column) -> Column:
    """Zero-padded, so that ids sort as their numbers do."""
    return F.concat(F.lit(letter), F.lpad(number.cast("string"), 9, "0"))


def dense_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    for name, ours in _TYPES.items():
        kind = F.when(F.col("event_type") == name, F.lit(ours)).otherwise(kind)
    return read(spark, sf_dir, "events").select(
        _id("E", F.col("event_id")).alias("event_id"),
        _id("U", F.col("user_id")).alias("user_id"),
        _id("P", F.get_json_object("props", "$.k")).alias("product_id"),
        kind.alias("event_type"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.lit(None).cast("double").alias("weight"),
        F.lit(None).cast("string").alias("session_id"),
    )


def visitor_events(events: DataFrame, silence_hours: int = SILENCE_HOURS) -> DataFrame:
    """events with users cut into visitors: after so many hours without an event one comes back as another.

    user_id becomes `user-1`, `user-2` and so on in order of time.
    """
    line = Window.partitionBy("user_id").orderBy("timestamp", "event_id")
    gap = F.unix_micros("timestamp") - F.lag(F.unix_micros("timestamp")).over(line)
    visit = F.sum((F.coalesce(gap, F.lit(0)) > silence_hours * 3_600_000_000).cast("int")).over(line) + 1
    return events.withColumn("__gap", visit.cast("string")).withColumn("user_id", F.concat_ws("-", "user_id", "__gap")).drop("__gap")


def star_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six columns identify a line; together they are its event_id."""
    flag = F.lit("view")
    for name, ours in _FLAGS.items():
        flag = F.when(F.col("l_returnflag") == name, F.lit(ours)).otherwise(flag)
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    cents = F.lpad(F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), 12, "0")
    shipped = F.lpad(F.unix_micros(F.col("l_shipdate").cast("timestamp")).cast("string"), 18, "0")
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.concat_ws("-", pad("l_orderkey", 10), pad("l_linenumber", 4), pad("l_partkey", 9), pad("l_suppkey", 9), shipped, cents).alias("event_id"),
        _id("U", F.col("o_custkey")).alias("user_id"),
        _id("P", F.col("l_partkey")).alias("product_id"),
        flag.alias("event_type"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.lit(None).cast("double").alias("weight"),
        F.lit(None).cast("string").alias("session_id"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table has no ratings and no subcategory; fixed formulas stand in for them."""
    return read(spark, sf_dir, "part").select(
        _id("P", F.col("p_partkey")).alias("product_id"),
        F.col("p_name").alias("title"),
        F.concat_ws(" ", "p_type", "p_brand", "p_name").alias("description"),
        F.col("p_type").alias("category"),
        F.concat(F.lit("size"), F.floor(F.col("p_size") / 10).cast("string")).alias("subcategory"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"),
        (1 + F.pmod(F.col("p_partkey") * 7, F.lit(41)) / 10.0).alias("rating"),
        F.pmod(F.col("p_partkey") * 13, F.lit(500)).cast("long").alias("rating_count"),
        F.split("p_name", " ").alias("tags"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(_id("U", F.col("c_custkey")).alias("user_id"), F.lit("US").alias("country"), F.lit("25-34").alias("age_band"), F.lit(None).cast("timestamp").alias("created_at"))
