"""Ranking metrics per user and over users, from ranked lists and truth pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

EPS = 1e-12
MAX_LISTS = 200


def _at(recs: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Each list's prefixes: rows up to k for every k."""
    return recs.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k")


def metrics_at_k(recs: DataFrame, truth: DataFrame, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(user_id, k, precision, recall, map, ndcg, mrr, hit_rate) of the users with truth and a list.

    recs (user_id, product_id, rank) may name an item twice: each place is a hit for
    precision, one for recall. by: columns of recs, such as a model's name, that tell lists of one user apart; they come first.
    """
    relevant = truth.select("user_id", "product_id").distinct()
    n_rel = relevant.groupBy("user_id").agg(F.count("*").alias("n_rel"))
    rows = recs.select(*by, "user_id", "product_id", "rank").where(F.col("rank") <= max(ks)).join(n_rel, "user_id")
    hit = rows.join(relevant.withColumn("hit", F.lit(1)), ["user_id", "product_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    # Hits up to a rank are the same for every k, so they are counted before prefixes are made.
    so_far = Window.partitionBy(*by, "user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = _at(hit.withColumn("hits", F.sum("hit").over(so_far)), ks)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", "k").cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    out = hit.groupBy(*by, "user_id", "k", "n_rel").agg(
        (F.sum("hit") / F.col("k")).alias("precision"),
        (F.size(F.collect_set(F.when(F.col("hit") == 1, F.col("product_id")))) / F.col("n_rel")).alias("recall"),
        (F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)) / F.least("n_rel", "k")).alias("map"),
        F.sum(F.col("hit") / F.log2(F.col("rank") + 1.0)).alias("dcg"),
        F.coalesce(1 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.max("hit").cast("double").alias("hit_rate"),
    )
    return out.select(*by, "user_id", "k", "precision", "recall", "map", (F.col("dcg") / ideal).alias("ndcg"), "mrr", "hit_rate")


def catalog_coverage(recs: DataFrame, products: DataFrame, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(k, coverage): the share of the catalogue in at least one list. by: columns of recs that results are kept apart by; here and below they come first."""
    items = products.select("product_id").distinct()
    n = items.agg(F.count("*").alias("n"))
    shown = _at(recs, ks).select(*by, "k", "product_id").distinct().join(items, "product_id", "left_semi")
    return shown.groupBy(*by, "k").agg(F.count("*").alias("shown")).crossJoin(F.broadcast(n)).select(*by, "k", (F.col("shown") / F.col("n")).alias("coverage"))  # one row


def novelty(recs: DataFrame, shares: DataFrame, products: DataFrame, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(user_id, k, novelty): the mean of -log2 of the shares; catalogue items without one have the least."""
    known = products.select("product_id").distinct().join(shares, "product_id", "left").select("product_id", F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(EPS)).alias("p"))
    return _at(recs, ks).join(known, "product_id").groupBy(*by, "user_id", "k").agg(F.avg(-F.log2("p")).alias("novelty"))


def personalisation(recs: DataFrame, ks: Sequence[int], most: int = MAX_LISTS, by: Sequence[str] = ()) -> DataFrame:
    """(k, personalisation): one minus the mean Jaccard of pairs of lists with over one item.

    The definition takes every n-th list, 200 at most, in order of user_id; the lists are
    numbered by counting ranges, so only the chosen ones are brought together.
    """
    key = [*by, "k"]
    lists = _at(recs, ks).groupBy(*key, "user_id").agg(F.collect_set("product_id").alias("items"), F.count("*").alias("n")).where("n > 1")
    # Numbered by ranges of (k, user_id): a count within each range, moved up by the ranges before it.
    ranged = checkpointed(lists.repartitionByRange(*key, "user_id").withColumn("part", F.spark_partition_id()))
    inner = ranged.withColumn("in_part", F.row_number().over(Window.partitionBy(*key, "part").orderBy("user_id")))
    counts = ranged.groupBy(*key, "part").agg(F.count("*").alias("n_part"))
    before = counts.withColumn("before", F.coalesce(F.sum("n_part").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    sizes = counts.groupBy(*key).agg(F.sum("n_part").alias("n_lists"))
    numbered = inner.join(F.broadcast(before), [*key, "part"]).withColumn("nth", F.col("in_part") + F.col("before")).join(F.broadcast(sizes), key)  # a row for each k
    step = F.greatest(F.lit(1), F.floor(F.col("n_lists") / most))
    chosen = numbered.where((F.pmod(F.col("nth") - 1, step) == 0) & ((F.col("nth") - 1) / step < most)).select(*key, "nth", "items")
    a, b = chosen.select(*key, F.col("nth").alias("i"), F.col("items").alias("x")), chosen.select(*key, F.col("nth").alias("j"), F.col("items").alias("y"))
    overlap = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    mean = a.join(b, key).where("i < j").groupBy(*key).agg((1 - F.avg(overlap)).alias("personalisation"))
    return sizes.join(mean, key, "left").select(*key, F.coalesce("personalisation", F.lit(0.0)).alias("personalisation"))


def diversity(recs: DataFrame, cosines: DataFrame, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(user_id, k, diversity): one minus the mean similarity of different places of a list; short lists 0.

    cosines (i, j, cos) hold both directions; a missing pair counts as zero.
    """
    key = [*by, "user_id", "k"]
    rows = _at(recs.select(*by, "user_id", "product_id", "rank"), ks)
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n"))
    a, b = rows.select(*key, F.col("product_id").alias("i"), F.col("rank").alias("ra")), rows.select(*key, F.col("product_id").alias("j"), F.col("rank").alias("rb"))
    total = a.join(b, key).where("ra != rb").join(cosines, ["i", "j"]).groupBy(*key).agg(F.sum("cos").alias("total"))
    value = F.when(F.col("n") < 2, 0.0).otherwise(1 - F.coalesce("total", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1)))
    return sizes.join(total, key, "left").select(*key, value.alias("diversity"))
