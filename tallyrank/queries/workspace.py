"""What queries over one folder share, each made once: entities, cells, features, models."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import content, features, hybrid, interactions, knn, latent, popularity
from ..operators.sparse import packed
from ..operators.split import TemporalSplit, segments, temporal_split
from ..plans import tuning
from ..session import broadcast_by_measure, checkpointed
from ..sources import adapters

_made: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The folder's workspace in this session, whose joins broadcast by measured sizes from then on."""
    broadcast_by_measure(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        _made[key] = Workspace(spark, sf_dir)
    return _made[key]


def forget() -> None:
    """Drop all workspaces; what they made is made anew."""
    _made.clear()


class Models:
    """The fitted parts over a table of cells."""

    def __init__(self, work: Workspace, cells: DataFrame):
        self.work, self.cells, self.lists = work, work.keep(cells), {}

    @cached_property
    def near(self) -> DataFrame:
        return knn.neighbour_table(self.cells)

    @cached_property
    def two_factors(self) -> DataFrame:
        """What SQL can follow of the latent part: the two largest singular vectors. The default is latent.FACTORS."""
        return self.work.keep(latent.item_factors(self.cells, self.work.products, 2))

    def blends(self, k: int, weights: tuple[float, ...] = (0.5,)) -> DataFrame:
        """Collaborative lists with the latent part, one for each neighbour weight."""
        if ("blends", k, weights) not in self.lists:
            self.lists["blends", k, weights] = self.work.keep(hybrid.collaborative_variants(self.cells, self.work.products, self.near, self.two_factors, k, weights))
        return self.lists["blends", k, weights]

    @cached_property
    def content_scores(self) -> DataFrame:
        return self.work.keep(content.scores(self.cells, self.work.products, self.work.packs))

    def recommend(self, strategy: str, k: int) -> DataFrame:
        """Each user's k best, made once for each strategy and k."""
        if (strategy, k) not in self.lists:
            self.lists[strategy, k] = self.work.keep(self._recommend(strategy, k))
        return self.lists[strategy, k]

    def _recommend(self, strategy: str, k: int) -> DataFrame:
        if strategy == "popularity":
            return popularity.recommend(self.cells, self.work.products, k)
        if strategy == "collaborative":
            return knn.recommend(self.cells, self.work.products, self.near, k)
        if strategy == "content":
            return content.recommend(self.cells, self.work.products, self.work.packs, k)
        raise ValueError(f"no strategy {strategy!r}")

    def member(self, strategy: str) -> DataFrame:
        """The list that fusions take, 100 deep."""
        return self.recommend(strategy, 100)


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def keep(self, df: DataFrame) -> DataFrame:
        return checkpointed(df)

    @cached_property
    def events(self) -> DataFrame:
        return adapters.dense_events(self.spark, self.sf_dir)

    @cached_property
    def visits(self) -> DataFrame:
        """Events of visitors, with users of all segments among them."""
        return self.keep(adapters.visitor_events(self.events))

    @cached_property
    def star(self) -> DataFrame:
        return self.keep(adapters.star_events(self.spark, self.sf_dir))

    @cached_property
    def products(self) -> DataFrame:
        return adapters.catalogue(self.spark, self.sf_dir)

    @cached_property
    def users(self) -> DataFrame:
        return adapters.people(self.spark, self.sf_dir)

    @cached_property
    def features(self) -> DataFrame:
        return self.keep(features.item_features(self.products))

    @cached_property
    def packs(self) -> DataFrame:
        return self.keep(packed(self.features))

    @cached_property
    def models(self) -> Models:
        return Models(self, interactions.interaction_matrix(self.events, self.products))

    @cached_property
    def split(self) -> TemporalSplit:
        return temporal_split(adapters.star_events(self.spark, self.sf_dir), 5, 2)

    @cached_property
    def split_models(self) -> Models:
        return Models(self, interactions.interaction_matrix(self.split.train, self.products))

    @cached_property
    def tuning_split(self) -> TemporalSplit:
        return temporal_split(self.visits, 7, 2)

    @cached_property
    def tuning_models(self) -> Models:
        return Models(self, interactions.interaction_matrix(self.tuning_split.train, self.products))

    @cached_property
    def four_models(self) -> dict[str, DataFrame]:
        """Lists of 20 of each model over the visitors' split."""
        m = self.tuning_models
        blend = m.blends(100).drop("knn_weight")
        fused = self.keep(hybrid.recommend_rrf([(0.4, m.member("content")), (0.5, blend), (0.1, m.member("popularity"))], 20))
        return {"content": m.member("content").where("rank <= 20"), "collaborative": blend.where("rank <= 20"), "popularity": m.member("popularity").where("rank <= 20"), "hybrid": fused}

    def _judged(self, *lists: DataFrame) -> list[DataFrame]:
        """The lists of users with truth: tuning counts no other's."""
        users = self.keep(self.tuning_split.truth("val").select("user_id").distinct())
        return [x.join(users, "user_id", "left_semi") for x in lists]

    @cached_property
    def trial_scores(self) -> DataFrame:
        """Every fusion of the grid, scored on the validation part."""
        m, s = self.tuning_models, self.tuning_split
        trials = tuning.grid(self.spark, knn_weights=(1.0,))
        recs = self.keep(tuning.trial_recommendations(trials, *self._judged(m.member("content"), m.member("collaborative"), m.member("popularity"))))
        named = segments(s.train_counts).where("segment in ('all', 'cold_start')")
        return self.keep(trials.join(tuning.score_trials(recs, s.truth("val"), named, self.products), "trial"))

    @cached_property
    def full_trial_scores(self) -> DataFrame:
        """All trials of the grid, with the latent part in the collaborative member."""
        m, s = self.tuning_models, self.tuning_split
        trials = tuning.grid(self.spark)
        recs = self.keep(tuning.trial_recommendations(trials, *self._judged(m.member("content"), m.blends(100, tuning.KNN_WEIGHTS), m.member("popularity"))))
        named = segments(s.train_counts).where("segment in ('all', 'cold_start')")
        return self.keep(trials.join(tuning.score_trials(recs, s.truth("val"), named, self.products), "trial"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df
