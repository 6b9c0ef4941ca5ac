"""Training: tune, fit on everything, evaluate on what was held out, store a version."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import content, features, hybrid, interactions, knn, latent, popularity
from ..operators.sparse import packed
from ..operators.split import TemporalSplit, segments, temporal_split
from ..session import checkpointed
from ..settings import Settings
from ..sources.store import Store
from . import tuning
from .artifacts import ArtifactStore, data_fingerprint
from .evaluate import evaluate

STRATEGIES = ("content", "collaborative", "popularity", "hybrid")


@dataclass(frozen=True)
class FusionWeights:
    """Shares of the hybrid's members, and of the neighbours within the collaborative one."""

    content: float = 0.4
    collab: float = 0.5
    knn: float = 0.5

    @property
    def popularity(self) -> float:
        """What the other two leave."""
        return max(0.0, 1 - self.content - self.collab)

    @classmethod
    def of_trial(cls, trial: dict) -> FusionWeights:
        given = {f.name: trial.get(f"{f.name}_weight") for f in fields(cls)}
        return cls(**{name: float(x) for name, x in given.items() if x is not None})

    def as_params(self) -> dict[str, float]:
        """How an artifact stores them."""
        return {f"{name}_weight": getattr(self, name) for name in ("content", "collab", "popularity", "knn")}


class Fitted:
    """All strategies over one table of cells."""

    def __init__(self, cells: DataFrame, products: DataFrame, item_features: DataFrame, settings: Settings, params: dict[str, float]):
        self.products, self.features, self.settings, self.params = products, item_features, settings, params
        self.cells = checkpointed(cells)
        self.near = knn.neighbour_table(self.cells, settings.knn_top_k, settings.knn_shrink)
        self.factors = checkpointed(latent.item_factors(self.cells, products, settings.svd_factors))
        self.packs = checkpointed(packed(item_features))

    def collaborative(self, k: int, knn_weight: float | None = None) -> DataFrame:
        weight = self.params["knn_weight"] if knn_weight is None else knn_weight
        return hybrid.recommend_collaborative(self.cells, self.products, self.near, self.factors, k, weight)

    def recommend(self, strategy: str, k: int) -> DataFrame:
        """(user_id, product_id, score, rank) of every user with cells."""
        if strategy == "popularity":
            return popularity.recommend(self.cells, self.products, k)
        if strategy == "collaborative":
            return self.collaborative(k)
        if strategy == "content":
            return content.recommend(self.cells, self.products, self.packs, k)
        if strategy == "hybrid":
            depth = max(hybrid.DEPTH, k)
            return hybrid.recommend_rrf([(self.params[f"{n}_weight"], self.recommend(s, depth)) for n, s in (("content", "content"), ("collab", "collaborative"), ("popularity", "popularity"))], k)
        raise ValueError(f"no strategy {strategy!r}; there are {', '.join(STRATEGIES)}")

    def similar(self, product_id: str, k: int = 10, strategy: str = "hybrid") -> DataFrame:
        made: dict[str, Callable[[], DataFrame]] = {
            "content": lambda: content.similar(self.features, product_id, k),
            "collaborative": lambda: knn.similar(self.near, self.products, product_id, k),
            "hybrid": lambda: hybrid.similar(self.features, self.near, self.products, product_id, k, {"content": self.params["content_weight"], "collab": self.params["collab_weight"]}),
        }
        if strategy not in made:
            raise ValueError(f"strategy {strategy!r} has no similar items")
        return made[strategy]().drop("user_id")


def fit(events: DataFrame, products: DataFrame, settings: Settings, params: dict[str, float], item_features: DataFrame | None = None) -> Fitted:
    item_features = checkpointed(features.item_features(products)) if item_features is None else item_features
    cells = interactions.interaction_matrix(events, products, halflife_days=settings.recency_halflife_days)
    return Fitted(cells, products, item_features, settings, params)


def tune(split: TemporalSplit, fitted: Fitted) -> DataFrame:
    """The grid's trials with objective, ndcg and coverage, best first.

    Members are ranked once; only the neighbour weights change a member's list.
    """
    spark = fitted.cells.sparkSession
    trials = tuning.grid(spark)
    collab = checkpointed(hybrid.collaborative_variants(fitted.cells, fitted.products, fitted.near, fitted.factors, hybrid.DEPTH, tuning.KNN_WEIGHTS))
    recs = checkpointed(tuning.trial_recommendations(trials, fitted.recommend("content", hybrid.DEPTH), collab, fitted.recommend("popularity", hybrid.DEPTH)))
    named = segments(split.train_counts).where("segment in ('all', 'cold_start')")
    s = fitted.settings
    if s.tuning_max_users is not None:
        named = named.join(tuning.sample_users(split.truth("val"), s.tuning_max_users, s.tuning_seed), "user_id", "left_semi")
    scored = tuning.score_trials(recs, split.truth("val"), named, fitted.products, fitted.settings.tuning_coverage_weight)
    return trials.join(scored, "trial").orderBy(F.desc("objective"), "trial")


def train(spark: SparkSession, store: Store, artifacts: ArtifactStore, settings: Settings | None = None, tune_weights: bool = True) -> str:
    """Train and store a version; its name is returned. RuntimeError on an empty store."""
    settings = settings or Settings.from_env()
    products, events = checkpointed(store.products()), checkpointed(store.events())
    if not products.take(1) or not events.take(1):
        raise RuntimeError("the store holds no products or no events: insert them first")
    split = temporal_split(events, settings.eval_holdout_per_user + settings.tuning_val_size, settings.tuning_val_size)
    item_features = checkpointed(features.item_features(products))
    held = fit(split.train, products, settings, FusionWeights().as_params(), item_features)
    best: dict = {}
    if tune_weights:
        trials = [r.asDict() for r in tune(split, held).limit(15).collect()]
        best = trials[0] if trials else {}
        baseline = held.recommend("collaborative", 10)
        base = evaluate({"collaborative": baseline}, split.truth("val"), segments(split.train_counts).where("segment = 'all'"), products, interactions.popularity_share(held.cells), [10]).first()
        lift = tuning.lift(best.get("ndcg") or 0.0, base.ndcg if base else 0.0)
        artifacts.save_json("tuning.json", {"best": best, "top_trials": trials, "baseline_ndcg": base.ndcg if base else None, "baseline_coverage": base.coverage if base else None, "ndcg_lift": lift, "grid": {"content_weight": tuning.CONTENT_WEIGHTS, "collab_weight": tuning.COLLAB_WEIGHTS, "knn_weight": tuning.KNN_WEIGHTS}})
    params = FusionWeights.of_trial(best).as_params()
    held.params = params
    version = data_fingerprint(products, events).first().fingerprint
    most = max(settings.eval_top_k)
    lists = {s: checkpointed(held.recommend(s, most)) for s in STRATEGIES}
    metrics = evaluate(lists, split.truth("test"), segments(split.train_counts), products, interactions.popularity_share(held.cells), settings.eval_top_k).withColumn("model_version", F.lit(version))
    served = fit(events, products, settings, params, item_features)
    tables = {"products": products, "cells": served.cells, "neighbours": served.near, "factors": served.factors, "features": item_features, "packs": served.packs, "metrics": metrics}
    artifacts.save(version, tables, {"params": params, "strategies": STRATEGIES})
    return version
