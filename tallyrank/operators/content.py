"""Content recommendations: a user's strongest items against the catalogue's features.

The mean term is the product of an item with the profile, the weighted sum of the items in the
profile window made unit; the max term is the best product with anything seen; a small quality prior is
added. The items pass a block of users inside a task, where the products of each block of items with those that
the users have seen are made from their sparse rows (operators.sparse) and dropped again: no table of
cosines is stored, no join is on a feature, and a list keeps only each user's best so far. Where all users have seen
but few different items, the catalogue's products with these are stored instead, and no item is shuffled for a block of users
(operators.fewseen).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .features import item_cosine, l2_normalize, numeric_features
from .interactions import profile_window
from .ranking import rank_topk
from . import fewseen, sparse
from .sparse import PRODUCT_COLUMNS, block_count, block_of

# The terms' weights and the size of the profile window.
MEAN_WEIGHT = 0.5
MAX_WEIGHT = 0.5
QUALITY_WEIGHT = 0.05
WINDOW = 10
#: Users of a block in tiled scoring, and different items that they may have seen; items of a group that passes them, and parts to be made at least.
TILE_USERS = 2048
TILE_SEEN = 16384
GROUP_ITEMS = 65536
LEAST_PARTS = 64
AGGREGATES = ("mean", "max", "mean_max", "quality_only")
_LISTED = "user_id string, product_id string, score double"


def quality_prior(products: DataFrame) -> DataFrame:
    """(product_id, quality): a rating shrunk towards 4 by 30 votes, and the log count of ratings."""
    rows = numeric_features(products).select("product_id", "rating", "log_rating_count", F.expm1("log_rating_count").alias("n"))
    ends = rows.agg(F.min("log_rating_count").alias("low"), F.max("log_rating_count").alias("high"))
    bayes = (F.col("rating") * F.col("n") + 4.0 * 30.0) / (F.col("n") + 30.0)
    known = (F.col("log_rating_count") - F.col("low")) / (F.col("high") - F.col("low") + 1e-9)
    return rows.crossJoin(F.broadcast(ends)).select("product_id", (0.7 * ((bayes - 1.0) / 4.0) + 0.3 * known).alias("quality"))  # one row


def content_profile(cells: DataFrame, features: DataFrame, window: int = WINDOW) -> DataFrame:
    """(user_id, feature, value): unit profiles of the strongest cells."""
    top = profile_window(cells, window).select("user_id", "product_id", F.col("value").alias("w"))
    summed = top.join(features, "product_id").groupBy("user_id", "feature").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    return l2_normalize(summed, "user_id")


def _tiles(cells: DataFrame, items: DataFrame, packs: DataFrame, window: int, bounds: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """(part, kind, id, names, values, quality, common): a part is a block of users (kind 0: what they have seen), the packed rows of that (1) and a group of items (2), in this order.

    Before these come a user's two numbers of bounds (user_id, low, high) as kind -2 and the scores of near (user_id, product_id, score) for the group's items as kind -1.
    """
    n_seen = cells.select("product_id").distinct().count()
    # Users of a block share the rows that they have seen; these are few if the users' items are, else as many as the cells.
    n_ub = max(block_count(cells.select("user_id").distinct(), TILE_USERS), 1 if n_seen <= TILE_SEEN else block_count(cells, TILE_SEEN))
    n_ig = max(block_count(items, GROUP_ITEMS), min(block_count(items), -(-LEAST_PARTS // n_ub)))
    top = profile_window(cells, window).select("user_id", "product_id", F.col("value").alias("w"))
    history = cells.select("user_id", "product_id").join(top, ["user_id", "product_id"], "left").withColumn("ub", block_of("user_id", n_ub))
    own_or_zero = lambda c: (F.col(c) if c in items.columns else F.lit(0.0)).alias(c)
    row = lambda kind, key, names, values, numbers=(F.lit(0.0).alias("quality"), F.lit(0.0).alias("common")): [F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(names).alias("names"), F.col(values).alias("values"), *numbers]
    users = history.groupBy("ub", "user_id").agg(F.collect_list(F.struct("product_id", F.coalesce("w", F.lit(0.0)).alias("w"))).alias("c")).select("ub", *row(0, "user_id", "c.product_id", "c.w"))
    seen = history.select("ub", "product_id").distinct().join(packs, "product_id").select("ub", *row(1, "product_id", "fs", "vs"))
    people = users.unionByName(seen)
    if bounds is not None:
        both = bounds.select(block_of("user_id", n_ub).alias("ub"), "user_id", F.array().cast("array<string>").alias("names"), F.array("low", "high").alias("values"))
        people = people.unionByName(both.select("ub", *row(-2, "user_id", "names", "values")))
    people = people.withColumn("part", F.explode(F.sequence(F.col("ub") * n_ig, F.col("ub") * n_ig + n_ig - 1))).drop("ub")
    held = items.select(block_of("product_id", n_ig).alias("ig"), *row(2, "product_id", "fs", "vs", (own_or_zero("quality"), own_or_zero("common"))))
    held = held.withColumn("part", F.explode(F.sequence(F.col("ig"), F.col("ig") + (n_ub - 1) * n_ig, F.lit(n_ig)))).drop("ig")
    if near is not None:
        part = block_of("user_id", n_ub) * n_ig + block_of("product_id", n_ig)
        of_user = near.groupBy(part.alias("part"), "user_id").agg(F.collect_list(F.struct("product_id", "score")).alias("c"))
        held = held.unionByName(of_user.select("part", *row(-1, "user_id", "c.product_id", "c.score")))
    return people.unionByName(held).repartition(min(n_ub * n_ig, 10_000), "part").sortWithinPartitions("part", "kind", "id")


class _Users:
    """A block of users, the rows of what they have seen, and their terms with blocks of items."""

    def __init__(self, users: pa.RecordBatch, seen: pa.RecordBatch | None, bounds: pa.RecordBatch | None = None, near: pa.RecordBatch | None = None):
        self.bounds, self.near = bounds, near
        self.names = users.column("id").to_pylist()
        what = users.column("names").flatten().dictionary_encode()
        self.what, code, w = what.dictionary, np.asarray(what.indices), np.asarray(users.column("values").flatten())
        who = np.repeat(np.arange(len(self.names)), np.asarray(users.column("names").value_lengths()))
        held = seen.column("id") if seen is not None else pa.array([], pa.string())
        column = np.asarray(pc.fill_null(pc.index_in(self.what, value_set=held), -1), np.int64)[code]
        by_item = np.argsort(code, kind="stable")
        self.owners, self.owned = who[by_item], np.searchsorted(code[by_item], np.arange(len(self.what) + 1))
        order = np.lexsort((column, who))
        order = order[column[order] >= 0]
        self.who, self.column, self.w = who[order], column[order], w[order]
        features = seen.column("names").flatten().dictionary_encode() if seen is not None else pa.array([], pa.string()).dictionary_encode()
        self.features = features.dictionary
        sizes = np.asarray(seen.column("names").value_lengths()).astype(np.int64) if seen is not None else np.zeros(0, np.int64)
        self.seen = sparse.Rows(np.asarray(features.indices).astype(np.int64), np.asarray(seen.column("values").flatten(), np.float64) if seen is not None else np.zeros(0), sizes)
        self.length = self._lengths()

    def _lengths(self) -> np.ndarray:
        """Of each user's profile."""
        out, ends = np.zeros(len(self.names)), np.concatenate([[0], np.cumsum(self.seen.sizes)])
        mine = np.flatnonzero(self.w)
        bounds = np.searchsorted(self.who[mine], np.arange(len(self.names) + 1))
        for u in np.flatnonzero(np.diff(bounds)).tolist():
            some = mine[bounds[u] : bounds[u + 1]]
            spans = [slice(ends[c], ends[c + 1]) for c in self.column[some].tolist()]
            _, code = np.unique(np.concatenate([self.seen.codes[x] for x in spans]), return_inverse=True)
            out[u] = np.linalg.norm(np.bincount(code, np.concatenate([v * self.seen.values[x] for v, x in zip(self.w[some], spans, strict=True)])))
        return out

    def terms(self, items: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """(mean, best, own) of all users and these items (0: nothing shared), and the places of what is seen."""
        lists = items.column("names")
        code = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=self.features), -1), np.int64)
        row = np.repeat(np.arange(len(items)), np.asarray(lists.value_lengths().fill_null(0)))[code >= 0]
        rows = sparse.Rows(code[code >= 0], np.asarray(items.column("values").flatten(), np.float64)[code >= 0], np.bincount(row, minlength=len(items)))
        mean, best = (np.zeros((len(self.names), len(items))) for _ in range(2))
        for first in range(0, len(self.seen), PRODUCT_COLUMNS):
            cos = np.ascontiguousarray(sparse.products(rows, self.seen.part(first, first + PRODUCT_COLUMNS), len(self.features)).T)
            here = np.flatnonzero((self.column >= first) & (self.column < first + PRODUCT_COLUMNS))
            bounds = np.searchsorted(self.who[here], np.arange(len(self.names) + 1))
            for u in np.flatnonzero(np.diff(bounds)).tolist():
                mine = here[bounds[u] : bounds[u + 1]]
                met, w = cos[self.column[mine] - first], self.w[mine]
                np.maximum(best[u], met.max(axis=0), out=best[u])
                mean[u] += w[w != 0] @ met[w != 0]
        mean *= np.divide(1, self.length, out=np.zeros(len(self.length)), where=self.length > 0)[:, None]
        code = np.asarray(pc.fill_null(pc.index_in(items.column("id"), value_set=self.what), -1), np.int64)
        spans = [(i, slice(self.owned[c], self.owned[c + 1])) for i, c in enumerate(code.tolist()) if c >= 0]
        whose = np.concatenate([self.owners[x] for _, x in spans] or [np.zeros(0, np.int64)])
        return mean, best, (whose, np.repeat([i for i, _ in spans], [x.stop - x.start for _, x in spans]).astype(np.int64))


    def low_high(self) -> np.ndarray:
        """The users' bounds, (2, users)."""
        out = np.zeros((len(self.names), 2))
        out[self._at(self.bounds)] = np.asarray(self.bounds.column("values").flatten()).reshape(-1, 2)
        return out.T

    def near_scores(self, items: pa.RecordBatch) -> np.ndarray:
        """The users' other scores of these items, 0 where there is none."""
        out = np.zeros((len(self.names), len(items)))
        if self.near is not None:
            what = self.near.column("names").flatten().dictionary_encode()
            place = np.asarray(pc.fill_null(pc.index_in(what.dictionary, value_set=items.column("id")), -1), np.int64)[np.asarray(what.indices)]
            who = np.repeat(self._at(self.near), np.asarray(self.near.column("names").value_lengths()))
            out[who[place >= 0], place[place >= 0]] = np.asarray(self.near.column("values").flatten())[place >= 0]
        return out

    def _at(self, rows: pa.RecordBatch) -> np.ndarray:
        return np.asarray(pc.index_in(rows.column("id"), value_set=pa.array(self.names, pa.string())), np.int64)


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[_Users, pa.RecordBatch]]:
    """The users of each part beside its items, block by block."""
    now, users, held = None, None, {}
    joined = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None
    for batch in batches:
        part, kind = (np.asarray(batch.column(c)) for c in ("part", "kind"))
        cuts = [0, *(np.flatnonzero(np.diff(part) | np.diff(kind)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if part[a] != now:
                now, users, held = part[a], None, {}
            if kind[a] < 2:
                held.setdefault(int(kind[a]), []).append(batch.slice(a, b - a))
            elif 0 in held:
                users = users or _Users(*(joined(held.get(x)) for x in (0, 1, -2, -1)))
                for c in range(a, b, sparse.BLOCK_ROWS):
                    yield users, batch.slice(c, min(sparse.BLOCK_ROWS, b - c))


class _Best:
    """Each user's k best of the items met so far, which come in order of id: ties go to the earlier one."""

    def __init__(self, users: _Users, k: int):
        self.users, self.k, self.n_met = users, k, 0
        self.edge = np.full(len(users.names), -np.inf)
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object))]
        self.n_new = 0

    def add(self, ids: list[str], score: np.ndarray) -> None:
        """Scores of all users and some items; minus infinity is never listed."""
        order = np.round(score, 9)
        if order.shape[1] > self.k:  # k of these items alone are as good as the k-th of them
            np.maximum(self.edge, np.partition(order, -self.k, axis=1)[:, -self.k], out=self.edge)
        who, item = np.nonzero((order >= self.edge[:, None]) & (order > -np.inf))
        self.held.append((who, item + self.n_met, score[who, item], np.array(ids, object)[item]))
        self.n_met += len(ids)
        self.n_new += len(who)
        if self.n_new > self.k * len(self.edge):
            self._cut()

    def _cut(self) -> None:
        who, place, score, ids = (np.concatenate(x) for x in zip(*self.held, strict=True))
        by = np.lexsort((place, -np.round(score, 9), who))
        nth = np.arange(len(by)) - np.searchsorted(who[by], who[by])
        last = by[nth == self.k - 1]
        self.edge[who[last]] = np.round(score[last], 9)
        by = by[nth < self.k]
        self.held, self.n_new = [(who[by], place[by], score[by], ids[by])], 0

    def rows(self) -> pa.RecordBatch:
        self._cut()
        who, _, score, ids = self.held[0]
        return pa.RecordBatch.from_arrays([pa.array(self.users.names, pa.string()).take(pa.array(who)), pa.array(ids, pa.string()), pa.array(score)], ["user_id", "product_id", "score"])


def _lists(scored: Iterable[tuple[_Users, list[str], np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """(user_id, product_id, score): the k best of each user in each part."""
    best = None
    for users, ids, score in scored:
        if best is None or best.users is not users:
            if best is not None:
                yield best.rows()
            best = _Best(users, k)
        best.add(ids, score)
    if best is not None:
        yield best.rows()


def terms(cells: DataFrame, packs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(user_id, product_id, mean, best) of users and all packed items that share a feature with what they have seen.

    mean is null where nothing in the profile window shares one.
    """
    if (known := fewseen.known_items(cells)) is not None:
        return fewseen.Meeting(cells, packs, packs, known, window, LEAST_PARTS).scored(fewseen.terms, "user_id string, product_id string, mean double, best double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for users, items in _parts(batches):
            means, bests, _ = users.terms(items)
            for user, mean, best in zip(users.names, means, bests, strict=True):
                met = np.flatnonzero(best)
                yield pa.RecordBatch.from_arrays([pa.array([user] * len(met), pa.string()), items.column("id").take(pa.array(met)), pa.array(mean[met], mask=mean[met] == 0), pa.array(best[met])], ["user_id", "product_id", "mean", "best"])

    return _tiles(cells, packs, packs, window).mapInArrow(run, "user_id string, product_id string, mean double, best double")


def mean_scores(cells: DataFrame, packs: DataFrame, window: int = WINDOW) -> DataFrame:
    return terms(cells, packs, window).where("mean is not null").select("user_id", "product_id", F.col("mean").alias("score"))


def max_scores(cells: DataFrame, packs: DataFrame) -> DataFrame:
    return terms(cells, packs).select("user_id", "product_id", F.col("best").alias("score"))


def scores(cells: DataFrame, products: DataFrame, packs: DataFrame, users: DataFrame | None = None, aggregate: str = "mean_max") -> DataFrame:
    """(user_id, product_id, score) of each user (those with cells by default) and the whole catalogue.

    aggregate quality_only leaves the mean term out; the other names give the same scores.
    """
    if aggregate not in AGGREGATES:
        raise ValueError(f"aggregate {aggregate!r} is none of {', '.join(AGGREGATES)}")
    people = (users if users is not None else cells).select("user_id").distinct()
    # Every item has a quality, so the result is dense by definition: users times items.
    base = people.join(quality_prior(products).withColumn("score", F.col("quality") * QUALITY_WEIGHT).drop("quality"))
    mean = F.lit(0.0) if aggregate == "quality_only" else F.coalesce("mean", F.lit(0.0)) * MEAN_WEIGHT
    met = terms(cells, packs).select("user_id", "product_id", (mean + F.col("best") * MAX_WEIGHT).alias("score"))
    return base.unionByName(met).groupBy("user_id", "product_id").agg(F.sum("score").alias("score"))


def recommend(cells: DataFrame, products: DataFrame, packs: DataFrame, k: int) -> DataFrame:
    """Each user's best k unseen items, as ranking the dense scores would give.

    A part's items pass its users block by block and only the k best of a user leave it, so the dense table is never written.
    """
    if (known := fewseen.known_items(cells)) is not None:
        meeting = fewseen.Meeting(cells, quality_prior(products), packs, known, WINDOW, LEAST_PARTS)
        return rank_topk(meeting.scored(lambda pairs: fewseen.lists(pairs, k, MEAN_WEIGHT, MAX_WEIGHT, QUALITY_WEIGHT), _LISTED), k)
    items = quality_prior(products).join(packs, "product_id", "left")

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[_Users, list[str], np.ndarray]]:
        for users, items in _parts(batches):
            mean, best, own = users.terms(items)
            score = MEAN_WEIGHT * mean + MAX_WEIGHT * best + QUALITY_WEIGHT * np.asarray(items.column("quality"))
            score[own] = -np.inf
            yield users, items.column("id").to_pylist(), score

    return rank_topk(_tiles(cells, items, packs, WINDOW).mapInArrow(lambda batches: _lists(scored(batches), k), _LISTED), k)


def _scaled(common: DataFrame) -> DataFrame:
    """(product_id, common): scores of the catalogue scaled to 0..1."""
    ends = common.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    scaled = F.when(F.col("high") - F.col("low") > 1e-12, (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    return common.crossJoin(F.broadcast(ends)).select("product_id", scaled.alias("common"))  # one row


def blended_few(cells: DataFrame, products: DataFrame, packs: DataFrame, near: DataFrame, common: DataFrame, k: int, shares: tuple[float, float, float], known: list[str], base: DataFrame | None = None) -> DataFrame:
    """blended() where all items of cells and near are the known ones; base (user_id, base) is what near has for items without a row, 0 by default."""
    counted = near
    if base is not None:
        counted = near.join(base, "user_id").select("user_id", "product_id", (F.col("score") - F.col("base")).alias("score"))
    items = quality_prior(products).join(_scaled(common), "product_id")
    meeting = fewseen.Meeting(cells, items, packs, known, WINDOW, LEAST_PARTS, checkpointed(counted))
    ends = meeting.scored(lambda pairs: fewseen.ranges(pairs, MEAN_WEIGHT, MAX_WEIGHT, QUALITY_WEIGHT), "user_id string, low double, high double")
    facts = ends.groupBy("user_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    facts = facts.join(base, "user_id") if base is not None else facts.withColumn("base", F.lit(0.0))
    return rank_topk(meeting.scored(lambda pairs: fewseen.lists(pairs, k, MEAN_WEIGHT, MAX_WEIGHT, QUALITY_WEIGHT, shares), _LISTED, checkpointed(facts)), k)


def blended(cells: DataFrame, products: DataFrame, packs: DataFrame, near: DataFrame, common: DataFrame, k: int, shares: tuple[float, float, float]) -> DataFrame:
    """Each user's best k unseen items by shares of the content score, of near (user_id, product_id, score) and of common (product_id, score).

    near is 0 to 1 within a user, and 0 where it has no row; the two others are scaled by their least and largest score over the
    catalogue. Content scores are made twice, for their bounds and for the lists, so no table of users times items is written.
    """
    if (known := fewseen.known_items(cells, near)) is not None:
        return blended_few(cells, products, packs, near, common, k, shares, known)
    of_content, of_near, of_common = shares
    items = checkpointed(quality_prior(products).join(packs, "product_id", "left").join(_scaled(common), "product_id"))

    def content_scores(users: _Users, items: pa.RecordBatch) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        mean, best, own = users.terms(items)
        return MEAN_WEIGHT * mean + MAX_WEIGHT * best + QUALITY_WEIGHT * np.asarray(items.column("quality")), own

    def ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for users, items in _parts(batches):
            score, _ = content_scores(users, items)
            yield pa.RecordBatch.from_arrays([pa.array(users.names, pa.string()), pa.array(score.min(axis=1)), pa.array(score.max(axis=1))], ["user_id", "low", "high"])

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[_Users, list[str], np.ndarray]]:
        for users, items in _parts(batches):
            score, own = content_scores(users, items)
            low, high = users.low_high()
            some = high - low > 1e-12
            score = (score - low[:, None]) * np.divide(of_content, high - low, out=np.zeros(len(low)), where=some)[:, None]
            score += of_near * users.near_scores(items) + of_common * np.asarray(items.column("common"))
            score[own] = -np.inf
            yield users, items.column("id").to_pylist(), score

    bounds = _tiles(cells, items, packs, WINDOW).mapInArrow(ranges, "user_id string, low double, high double").groupBy("user_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    lists = _tiles(cells, items, packs, WINDOW, checkpointed(bounds), near).mapInArrow(lambda batches: _lists(scored(batches), k), _LISTED)
    return rank_topk(lists, k)


def similar(features: DataFrame, product_id: str, k: int = 10, exclude_self: bool = True) -> DataFrame:
    """The items nearest to one by cosine; KeyError if it has no features."""
    if not features.where(F.col("product_id") == product_id).take(1):
        raise KeyError(product_id)
    one = features.where(F.col("product_id") == product_id)
    sims = item_cosine(features, one).select(F.col("j").alias("user_id"), F.col("i").alias("product_id"), F.col("cos").alias("score"))
    mask = sims.sparkSession.createDataFrame([(product_id, product_id)], "user_id string, product_id string")
    return rank_topk(sims, k, exclude=mask if exclude_self else None)


def folded(state: dict[str, float], steps: Iterable[tuple[float, Mapping[str, float]]]) -> dict[str, float]:
    """state after each step added its weight times an item's features and was made unit again.

    The sums are kept unscaled beside one running length, so a step costs the item's features.
    """
    total, scale = dict(state), 1.0
    square = sum(v * v for v in total.values())
    for weight, item in steps:
        for f, v in item.items():
            old = total.get(f, 0.0)
            new = old + weight * scale * v
            total[f] = new
            square += new * new - old * old
        if square > 0:
            scale = square**0.5
        if scale > 1e100:
            total = {f: v / scale for f, v in total.items()}
            square, scale = square / scale / scale, 1.0
    length = sum(v * v for v in total.values()) ** 0.5
    return {f: v / length for f, v in total.items()} if length > 0 else total


def fold_event(profile: DataFrame, features: DataFrame, events: DataFrame) -> DataFrame:
    """(user_id, feature, value): profiles after live events (user_id, product_id, weight, timestamp, event_id).

    Events count in order of time, then id; items without features change nothing, and users
    without events keep their profile.
    """
    packed = lambda df, key: df.groupBy(key).agg(F.collect_list("feature").alias("fs"), F.collect_list("value").alias("vs"))
    items = packed(features, "product_id")
    first = F.lit("1970-01-01").cast("timestamp")  # kind comes first anyway
    steps = events.join(items, "product_id").select("user_id", F.lit(1).alias("kind"), F.col("timestamp").alias("at"), "event_id", F.col("weight").cast("double"), "fs", "vs")
    start = packed(profile, "user_id").select("user_id", F.lit(0).alias("kind"), first.alias("at"), F.lit("").alias("event_id"), F.lit(1.0).alias("weight"), "fs", "vs")

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["kind", "at", "event_id"])
        listed = [(k, w, dict(zip(fs, vs, strict=True))) for k, w, fs, vs in zip(rows["kind"], rows["weight"], rows["fs"], rows["vs"], strict=True)]
        state = {f: v for k, _, item in listed if k == 0 for f, v in item.items()}
        out = folded(state, [(w, item) for k, w, item in listed if k == 1])
        return pd.DataFrame({"user_id": key[0], "feature": list(out), "value": list(out.values())})

    return steps.unionByName(start).groupBy("user_id").applyInPandas(fold, "user_id string, feature string, value double")
