"""Fusion weights searched as one job: members are ranked once, all trials fuse together."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import metrics_at_k

# The grid of weights.
CONTENT_WEIGHTS = (0.0, 0.2, 0.3, 0.4, 0.5, 0.6)
COLLAB_WEIGHTS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
KNN_WEIGHTS = (0.3, 0.5, 0.7)
COVERAGE_WEIGHT = 0.05


def grid(spark: SparkSession, knn_weights: Sequence[float] = KNN_WEIGHTS) -> DataFrame:
    """(trial, content_weight, collab_weight, knn_weight, popularity_weight): content and collab stay under 1."""
    rows = [(c, k, n) for c in CONTENT_WEIGHTS for k in COLLAB_WEIGHTS for n in knn_weights if round(c + k, 9) < 1]
    data = [(i, c, k, n, max(0.0, 1 - c - k)) for i, (c, k, n) in enumerate(rows, 1)]
    return spark.createDataFrame(data, "trial int, content_weight double, collab_weight double, knn_weight double, popularity_weight double")


def trial_recommendations(trials: DataFrame, content: DataFrame, collab: DataFrame, popularity: DataFrame, k: int = 10, rrf_k: int = 60) -> DataFrame:
    """(trial, user_id, product_id, score, rank) of every trial.

    Members are ranked lists; collab may hold knn_weight to tell its variants apart. A user's list
    entries meet in one row for each item and are shuffled once, whatever the number of trials (tens of rows, read by
    the driver): all are fused from there in the task, user by user, and only the k best of each leave it.
    """
    plan = [tuple(r) for r in trials.select("trial", "knn_weight", "content_weight", "collab_weight", "popularity_weight").collect()]
    variants = sorted({n for _, n, *_ in plan})
    place = {n: 1 + i for i, n in enumerate(variants)}
    # A member's rank stands in its own place: content, the collaborative variants (one for all without knn_weight), popularity.
    of = F.col("knn_weight") if "knn_weight" in collab.columns else F.lit(None).cast("double")
    every = collab.select("user_id", "product_id", "rank", of.alias("variant"))
    parts = [df.select("user_id", "product_id", "rank", F.lit(at).alias("at")) for at, df in ((0, content), (len(variants) + 1, popularity))]
    parts += [every.where(F.col("variant").isNull() | (F.col("variant") == n)).select("user_id", "product_id", "rank", F.lit(at).alias("at")) for n, at in place.items()]
    # Dealt by a hash of the id: a repartition by the id itself is dropped where joins have dealt all parts by it, and these may turn into broadcasts later.
    entries = reduce(DataFrame.unionByName, parts).repartition(F.xxhash64("user_id")).sortWithinPartitions("user_id", "product_id")

    def fused(who: pa.Array, what: pa.Array, rank: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All trials of whole users; items of a user are in order of id, so equals keep it."""
        user, item = (np.asarray(x.dictionary_encode().indices).astype(np.int64) for x in (who, what))
        new = np.concatenate([[True], (np.diff(user) != 0) | (np.diff(item) != 0)])
        row, first = np.cumsum(new) - 1, np.flatnonzero(new)
        share = np.zeros((len(first), len(variants) + 2))
        np.add.at(share, (row, at), 1.0 / (rrf_k + rank))
        owner = user[first]
        for trial, n, c, w, p in plan:
            weights = np.zeros(share.shape[1])
            weights[[0, place[n], -1]] = np.maximum([c, w, p], 0)
            some = np.flatnonzero((share[:, weights > 0] > 0).any(axis=1))
            score = share[some] @ weights
            some, score = (x[np.lexsort((some, -np.round(score, 9), owner[some]))] for x in (some, score))
            nth = np.arange(len(some)) - np.searchsorted(owner[some], owner[some])
            keep = nth < k
            rows = pa.array(first[some[keep]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(keep.sum(), trial, np.int32)), who.take(rows), what.take(rows), pa.array(score[keep]), pa.array((nth[keep] + 1).astype(np.int32))], ["trial", "user_id", "product_id", "score", "rank"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                # The last user may go on in the next batch.
                last = int(np.asarray(pc.index(held.column("user_id"), held.column("user_id")[-1]).as_py()))
                if last:
                    yield from fused(*columns(held.slice(0, last)))
                held = held.slice(last)
        if held is not None:
            yield from fused(*columns(held))

    def columns(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
        return batch.column("user_id"), batch.column("product_id"), np.asarray(batch.column("rank")), np.asarray(batch.column("at"))

    return entries.mapInArrow(run, "trial int, user_id string, product_id string, score double, rank int")


def score_trials(recs: DataFrame, truth: DataFrame, segments: DataFrame, products: DataFrame, coverage_weight: float = COVERAGE_WEIGHT, k: int = 10) -> DataFrame:
    """(trial, objective, ndcg, coverage): the mean over segments of NDCG plus the weighted coverage.

    ndcg and coverage are those of the segment all. Users without truth count nowhere.
    """
    pairs = recs.select("trial", "user_id").distinct().join(truth.select("user_id", "product_id").distinct(), "user_id")
    key = F.concat_ws("#", "user_id", F.col("trial").cast("string"))
    listed = recs.join(truth.select("user_id").distinct(), "user_id", "left_semi")
    per_user = metrics_at_k(listed.select(key.alias("user_id"), "product_id", "rank"), pairs.select(key.alias("user_id"), "product_id"), [k])
    scored = per_user.select(F.substring_index("user_id", "#", 1).alias("user_id"), F.substring_index("user_id", "#", -1).cast("int").alias("trial"), "ndcg")
    ndcg = scored.join(segments, "user_id").groupBy("trial", "segment").agg(F.avg("ndcg").alias("ndcg"))
    n_items = products.select("product_id").distinct().agg(F.count("*").alias("n"))
    shown = listed.join(segments, "user_id").select("trial", "segment", "product_id").distinct().join(products.select("product_id").distinct(), "product_id", "left_semi")
    coverage = shown.groupBy("trial", "segment").agg(F.count("*").alias("shown")).crossJoin(F.broadcast(n_items)).select("trial", "segment", (F.col("shown") / F.col("n")).alias("coverage"))  # one row
    both = ndcg.join(coverage, ["trial", "segment"])
    of_all = lambda c: F.max(F.when(F.col("segment") == "all", F.col(c))).alias(c)
    return both.groupBy("trial").agg(F.avg(F.col("ndcg") + coverage_weight * F.col("coverage")).alias("objective"), of_all("ndcg"), of_all("coverage"))


def sample_users(users: DataFrame, n: int = 300, seed: int = 7) -> DataFrame:
    """n users by a seeded hash: an option, as one job over all users needs no sample."""
    return users.select("user_id").distinct().orderBy(F.xxhash64("user_id", F.lit(seed)), "user_id").limit(n)


def lift(best: float, baseline: float) -> float:
    return (best - baseline) / baseline if baseline else 0.0
