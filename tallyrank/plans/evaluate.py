"""Offline evaluation: fit once on the training part, score many segments and prefixes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import catalog_coverage, diversity, metrics_at_k, novelty, personalisation
from ..session import checkpointed

METRICS = ("precision", "recall", "map", "ndcg", "mrr", "hit_rate")


BEYOND = ("coverage", "novelty", "personalisation", "diversity", "mean_recommendations")


def of_models(recs: Mapping[str, DataFrame]) -> DataFrame:
    """All models' lists one below the other: model, user_id, product_id, rank."""
    return reduce(DataFrame.unionByName, (lists.select(F.lit(name).alias("model"), "user_id", "product_id", "rank") for name, lists in recs.items()))


def summarise(recs: DataFrame, truth: DataFrame, segments: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(model, segment, k, n_users and the means of METRICS) of users with truth and a list; recs as of_models() gives them."""
    per_user = metrics_at_k(recs, truth, ks, ["model"]).join(segments, "user_id")
    return per_user.groupBy("model", "segment", "k").agg(F.count("*").alias("n_users"), *(F.avg(c).alias(c) for c in METRICS))


def evaluate(recs: Mapping[str, DataFrame], truth: DataFrame, segments: DataFrame, products: DataFrame, shares: DataFrame, ks: Sequence[int] = (5, 10, 20), cosines: DataFrame | None = None) -> DataFrame:
    """One row per model, segment and k, best NDCG first; metrics to five places.

    recs holds each model's lists at the largest k; smaller ones are their prefixes. All models and
    segments are measured together. cosines (i, j, cos) give diversity, which is null without them.
    """
    lists = checkpointed(of_models(recs).join(truth.select("user_id").distinct(), "user_id", "left_semi"))
    group = ["model", "segment", "k"]
    by = group[:2]
    own = checkpointed(lists.join(segments, "user_id"))
    mean = lambda per_user, c: per_user.join(segments, "user_id").groupBy(*group).agg(F.avg(c).alias(c))
    sizes = lists.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k").groupBy("model", "k", "user_id").agg(F.count("*").alias("mean_recommendations"))
    out = summarise(lists, truth, segments, ks).join(catalog_coverage(own, products, ks, by), group)
    out = out.join(mean(novelty(lists, shares, products, ks, ["model"]), "novelty"), group).join(personalisation(own, ks, by=by), group)
    out = out.join(mean(sizes, "mean_recommendations"), group)
    if cosines is None:
        out = out.withColumn("diversity", F.lit(None).cast("double"))
    else:
        out = out.join(mean(diversity(lists, cosines, ks, ["model"]), "diversity"), group)
    rounded = out.select(*group, "n_users", *(F.round(c, 5).alias(c) for c in (*METRICS, *BEYOND)))
    return rounded.orderBy("segment", "k", F.desc("ndcg"))
