import re
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyrank.functions.text import char_ngrams, clean_text, word_ngrams
from tallyrank.functions.weights import event_weight, recency_decay
from tallyrank.operators import content, features, hybrid, interactions, knn, latent, popularity, sparse
from tallyrank.operators.ranking import numbered, padded, rank_topk
from tallyrank.operators.split import segments, temporal_split
from tallyrank.sources.schemas import EVENT, POSITIVE_EVENTS

T0 = datetime(2026, 1, 1, tzinfo=UTC)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def world(spark):
    r = np.random.default_rng(11)
    products = [(f"P{i:03d}", f"{['red', 'blue', 'hot'][i % 3]} {['ring', 'bolt', 'gear'][i % 3 - i % 2]}", f"thing {i % 7}", f"c{i % 4}", f"s{i % 6}", f"b{i % 5}", float(np.exp(r.normal(3, 0.6))), float(r.uniform(2.5, 5)), int(r.integers(0, 2000)), [f"t{i % 3}"], None) for i in range(90)]
    kinds = r.choice(["purchase", "add_to_cart", "wishlist", "view"], 3000, p=[0.12, 0.16, 0.17, 0.55])
    events = [(f"E{i:05d}", f"U{int(r.integers(0, 60)):03d}", f"P{int(r.integers(0, 70)):03d}", str(kinds[i]), T0 - timedelta(minutes=int(r.integers(0, 170_000))), None, None) for i in range(3000)]
    p = spark.createDataFrame(products, "product_id string, title string, description string, category string, subcategory string, brand string, price double, rating double, rating_count long, tags array<string>, created_at timestamp").cache()
    e = spark.createDataFrame(events, EVENT).cache()
    cells = interactions.interaction_matrix(e, p).cache()
    return p, e, cells


def dense(cells):
    rows = cells.collect()
    users, items = sorted({r.user_id for r in rows}), sorted({r.product_id for r in rows})
    m = np.zeros((len(users), len(items)))
    for r in rows:
        m[users.index(r.user_id), items.index(r.product_id)] = r.value
    return users, items, m


def test_clean_text(spark):
    assert one(spark, clean_text(F.col("t")), t="Noise-Cancelling, WIRELESS!") == "noise cancelling wireless"
    assert one(spark, clean_text(F.lit(None).cast("string")), t="x") == ""


def test_ngrams(spark):
    assert one(spark, word_ngrams(F.col("t")), t="a bc def bc") == ["bc", "def", "bc", "bc def", "def bc"]
    assert one(spark, word_ngrams(F.col("t")), t="a") == []

    def slow(text):
        out = []
        for w in text.split():
            w = f" {w} "
            for n in (3, 4, 5):
                at = 0
                out.append(w[:n])
                while at + n < len(w):
                    at += 1
                    out.append(w[at : at + n])
                if at == 0:
                    break
        return sorted(out)

    for text in ("a bc def ghij klmno pqrstu", "x", "", "ab  cd"):
        assert sorted(one(spark, char_ngrams(F.col("t")), t=text)) == slow(text)


def test_weights(spark):
    rows = spark.createDataFrame([("purchase", None), ("rating", None), ("unknown", None), (None, None), ("view", 7.0), ("view", -1.0), ("wishlist", 0.0)], "t string, w double")
    assert [r.x for r in rows.select(event_weight(F.col("t"), F.col("w")).alias("x")).collect()] == [5, 4, 1, 1, 7, 1, 2]
    at = lambda days: recency_decay(F.lit(T0 - timedelta(days=days)), F.lit(T0), 30)
    assert one(spark, at(59), a=1) == pytest.approx(0.25, abs=0.02) and one(spark, at(-5), a=1) == 1 and one(spark, at(30), a=1) == 0.5


def test_repeats_collapse_and_unknown_items_go(spark, world):
    p, e, cells = world
    assert cells.count() == e.select("user_id", "product_id").distinct().count()
    assert interactions.interaction_matrix(e.limit(0), p).count() == 0
    assert interactions.interaction_matrix(e, p.where("product_id < 'P010'")).where("product_id >= 'P010'").count() == 0
    late = interactions.interaction_matrix(e, reference=T0 + timedelta(days=30))
    assert late.agg(F.sum("value")).first()[0] < cells.agg(F.sum("value")).first()[0]


def test_rank_order_and_masks(spark):
    scores = spark.createDataFrame([("u", "b", 1.0), ("u", "a", 1.0), ("u", "c", 0.5), ("u", "d", 2.0)], "user_id string, product_id string, score double")
    names = lambda df: [r.product_id for r in df.orderBy("rank").collect()]
    ban = spark.createDataFrame([("u", "d"), ("v", "a")], "user_id string, product_id string")
    assert names(rank_topk(scores, 3)) == ["d", "a", "b"] and names(rank_topk(scores, 2, exclude=ban)) == ["a", "b"]
    assert names(rank_topk(scores, 1, exclude=ban, include_seen=True)) == ["d"]
    assert names(rank_topk(scores, 9, candidates=ban.select(F.lit("c").alias("product_id")))) == ["c"] and rank_topk(scores, 0).count() == 0


def test_numbered_places(spark):
    items = spark.createDataFrame([(f"p{i:02d}", float(i % 5)) for i in range(40)], "product_id string, score double").repartition(7)
    got = {r.product_id: r.place for r in numbered(items).collect()}
    assert got == {p: n for n, (_, p) in enumerate(sorted((-(i % 5), f"p{i:02d}") for i in range(40)), 1)}


@pytest.mark.parametrize("block, held", [(512, 1 << 22), (4, 5)])
def test_tiled_pairs_equal_joined_pairs(spark, world, block, held, monkeypatch):
    _, _, cells = world
    monkeypatch.setattr(knn, "HISTORY_BLOCK", block)
    monkeypatch.setattr(knn, "PAIRS_HELD", held)
    for unit in (True, False):
        rows = cells.join(cells.groupBy("user_id").agg(F.expr("sqrt(sum(value * value))").alias("l")), "user_id").selectExpr("user_id", "product_id", f"value / {'l' if unit else 1} r")
        a, b = rows.selectExpr("user_id", "product_id i", "r ri"), rows.selectExpr("user_id", "product_id j", "r rj")
        want = a.join(b, "user_id").where("i <= j").groupBy("i", "j").agg(F.expr("sum(ri * rj)").alias("want"))
        got = knn.cooccurrence(cells, unit)
        assert got.count() == want.count() == got.join(want, ["i", "j"]).where("abs(dot - want) < 1e-9").count()


def test_one_long_history_is_many_tasks(spark):
    """A user with 3,000 items among short ones: tiles of all tasks stay small."""
    cells = spark.range(3000).selectExpr("'U' user_id", "concat('P', id) product_id", "1.0D value").unionByName(spark.range(200).selectExpr("concat('u', id % 50) user_id", "concat('P', id) product_id", "2.0D value"))
    rows = cells.join(cells.groupBy("user_id").agg(F.count("*").alias("n")), "user_id").withColumn("r", F.col("value"))
    tiles = knn._history_tiles(rows).withColumn("task", F.spark_partition_id()).selectExpr("task", "size(a) na", "coalesce(size(b), 0) nb").collect()
    assert max(t.na for t in tiles) < 2 * knn.HISTORY_BLOCK and sum(t.nb > 0 for t in tiles) == 15
    assert len({t.task for t in tiles if t.nb > 0}) > 2
    assert knn.cooccurrence(cells, False).where("dot > 0").count() == 3000 * 3001 // 2


def test_fitted_features_describe_items(spark, world, tmp_path):
    p, _, _ = world
    whole = features.item_features(p).cache()
    features.FittedFeatures.fit(p).save(f"file://{tmp_path}/fitted")
    fitted = features.FittedFeatures.load(spark, f"file://{tmp_path}/fitted")
    same = lambda a, b: a.count() == b.count() == a.join(b.withColumnRenamed("value", "other"), ["product_id", "feature"]).where("abs(value - other) < 1e-9").count()
    assert same(fitted.transform(p), whole)
    assert same(fitted.describe(["P007", "P003"]), whole.where("product_id in ('P003', 'P007')"))
    names, rows = fitted.dense(["P007", "P003", "P007"])
    assert rows.shape == (3, len(names)) and np.allclose(np.linalg.norm(rows, axis=1), 1) and (rows[0] == rows[2]).all() and (rows[0] != rows[1]).any()
    with pytest.raises(KeyError):
        fitted.describe(["P003", "nope"])
    new = p.limit(1).withColumn("product_id", F.lit("NEW")).withColumn("brand", F.lit("never seen")).withColumn("title", F.lit("zzzz red"))
    got = {r.feature for r in fitted.transform(new).collect()}
    assert "word:red" in got and "word:zzzz" not in got and "taxonomy:brand=never seen" not in got


def test_padding_equals_dense_ranking(spark, world):
    p, _, cells = world
    near = knn.neighbours(knn.similarity(cells), 5)
    sparse, seen = knn.scores(cells, near), interactions.seen_items(cells)
    full = cells.select("user_id").distinct().join(p.select("product_id")).join(sparse, ["user_id", "product_id"], "left").select("user_id", "product_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    want = rank_topk(full, 40, exclude=seen).select("user_id", "product_id", "rank")
    got = rank_topk(padded(sparse, cells, p, seen, 40), 40, exclude=seen).select("user_id", "product_id", "rank")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def _joined_cosines(f):
    """All pairs by a join on the feature: what blocks of sparse rows have to agree with."""
    a, b = f.selectExpr("feature", "product_id i", "value vi"), f.selectExpr("feature", "product_id j", "value vj")
    return a.join(b, "feature").groupBy("i", "j").agg(F.sum(F.col("vi") * F.col("vj")).alias("want"))


@pytest.mark.parametrize("rows, step, share", [(1024, 1 << 22, 8), (7, 50, 1), (9, 40, 1000)])
def test_blocked_products_equal_joined_cosines(spark, world, rows, step, share, monkeypatch):
    p, _, cells = world
    f = features.item_features(p).cache()
    for name, value in (("BLOCK_ROWS", rows), ("INDEX_STEP", step), ("DENSE_SHARE", share)):
        monkeypatch.setattr(sparse, name, value)
    want = _joined_cosines(f)
    got = features.item_cosine(f)
    assert got.count() == want.count() == got.join(want, ["i", "j"]).where("abs(cos - want) < 1e-9").count()
    some = features.item_cosine(f, cells.select("product_id").limit(3))
    assert some.count() == want.join(cells.select("product_id").limit(3).distinct().withColumnRenamed("product_id", "j"), "j").count()


def test_products_of_rows_without_names(spark):
    lists = lambda rows: (pa.array([[n for n, _ in r] for r in rows], pa.list_(pa.string())), pa.array([[v for _, v in r] for r in rows], pa.list_(pa.float64())))
    rows, other = [[("a", 1.0)], [], [("b", 2.0), ("c", 3.0)]], [[("c", 5.0), ("z", 1.0)], []]
    (a, b), n = sparse.coded([lists(rows), lists(other)])
    assert sparse.products(a, b, n).tolist() == [[0, 0], [0, 0], [15, 0]] and n == 4
    (a, b), n = sparse.coded([lists(rows), lists([])])
    assert sparse.products(a, b, n).shape == (3, 0)


@pytest.mark.parametrize("users, rows, columns", [(256, 1024, 2048), (7, 9, 3)])
def test_tiled_content_equals_dense_ranking(spark, world, users, rows, columns, monkeypatch):
    p, _, cells = world
    f = features.item_features(p).cache()
    packs = sparse.packed(f).cache()
    # Max and mean by joins over all cosines.
    best = cells.select("user_id", F.col("product_id").alias("j")).join(_joined_cosines(f), "j").groupBy("user_id", F.col("i").alias("product_id")).agg(F.max("want").alias("best"))
    mean = content.content_profile(cells, f).withColumnRenamed("value", "w").join(f, "feature").groupBy("user_id", "product_id").agg(F.sum(F.col("w") * F.col("value")).alias("mean"))
    dense = cells.select("user_id").distinct().join(content.quality_prior(p)).join(best, ["user_id", "product_id"], "left").join(mean, ["user_id", "product_id"], "left")
    dense = dense.select("user_id", "product_id", F.expr("0.05 * quality + 0.5 * coalesce(best, 0) + 0.5 * coalesce(mean, 0)").alias("score"))
    want = rank_topk(dense, 15, exclude=interactions.seen_items(cells))
    monkeypatch.setattr(content, "TILE_USERS", users)
    monkeypatch.setattr(sparse, "BLOCK_ROWS", rows)
    monkeypatch.setattr(content, "PRODUCT_COLUMNS", columns)
    got = content.recommend(cells, p, packs, 15).withColumnRenamed("score", "got")
    met = want.join(got, ["user_id", "product_id", "rank"])
    assert want.count() == got.count() == met.count() and met.where("abs(score - got) > 1e-9").count() == 0


@pytest.mark.parametrize("strategy", ["popularity", "knn", "content", "hybrid"])
def test_invariants(spark, world, strategy):
    p, _, cells = world
    near = knn.neighbours(knn.similarity(cells), 30)
    packs = sparse.packed(features.item_features(p))
    make = {"popularity": lambda k: popularity.recommend(cells, p, k), "knn": lambda k: knn.recommend(cells, p, near, k), "content": lambda k: content.recommend(cells, p, packs, k)}
    make["hybrid"] = lambda k: hybrid.recommend_rrf([(0.4, make["content"](100)), (0.5, make["knn"](100)), (0.1, make["popularity"](100))], k)
    rows = make[strategy](10).collect()
    seen = {(r.user_id, r.product_id) for r in cells.collect()}
    by = {}
    for r in rows:
        by.setdefault(r.user_id, []).append(r)
        assert (r.user_id, r.product_id) not in seen
    assert len(by) == cells.select("user_id").distinct().count()
    for own in by.values():
        own.sort(key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and all(round(a.score, 9) >= round(b.score, 9) for a, b in zip(own, own[1:]))


def test_knn_matches_numpy_and_is_symmetric_before_pruning(spark, world):
    _, _, cells = world
    _, items, m = dense(cells)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    n = m.sum(axis=0)
    want = unit.T @ unit / (1 + (n[:, None] + n[None, :]) / 10)
    np.fill_diagonal(want, 0)
    got = np.zeros_like(want)
    for r in knn.similarity(cells).collect():
        got[items.index(r.i), items.index(r.j)] = r.sim
    assert np.allclose(got, want) and np.allclose(got, got.T)
    near = knn.neighbours(knn.similarity(cells), 7)
    assert near.groupBy("i").count().agg(F.max("count")).first()[0] <= 7


def test_svd_matches_numpy(spark, world):
    p, _, cells = world
    users, items, m = dense(cells)
    factors = latent.item_factors(cells, p, n_factors=8)
    v = np.linalg.svd(m)[2][:8].T
    want = m @ v @ v.T
    got = np.zeros_like(want)
    for r in latent.scores(cells, factors).collect():
        got[users.index(r.user_id), items.index(r.product_id)] = r.score
    assert np.allclose(got, want, atol=1e-4)
    assert latent.explained(cells, factors) == pytest.approx((want**2).sum() / (m**2).sum(), abs=1e-4)


def test_tfidf_and_features_match_numpy(spark, world):
    p, _, _ = world
    rows = features.item_features(p).collect()
    by = {}
    for r in rows:
        by.setdefault(r.product_id, {})[r.feature] = r.value
    assert len(by) == 90 and all(sum(v * v for v in x.values()) == pytest.approx(1) for x in by.values())
    z = {r.product_id: r.value for r in features.scaled_numeric(p).where("feature = 'rating'").collect()}
    rating = {r.product_id: r.rating for r in p.collect()}
    mean, std = np.mean(list(rating.values())), np.std(list(rating.values()))
    assert all(z[k] == pytest.approx(abs(rating[k] - mean) / std) for k in z)
    with pytest.raises(KeyError):
        features.vector_for(features.item_features(p), "nope")


def test_l2_keeps_zero_rows(spark):
    rows = spark.createDataFrame([("a", 3.0), ("a", 4.0), ("z", 0.0)], "product_id string, value double")
    assert sorted(r.value for r in features.l2_normalize(rows).collect()) == pytest.approx([0, 0.6, 0.8])


def test_minmax(spark):
    rows = spark.createDataFrame([("a", x) for x in (0.0, 1.0, 2.0)] + [("b", 5.0)] * 3, "user_id string, score double")
    assert [r.score for r in interactions.minmax_per_user(rows).orderBy("user_id", "score").collect()] == [0, 0.5, 1, 0, 0, 0]


def test_content_mean_from_cosines_equals_profile_dot_features(spark, world):
    p, _, cells = world
    f = features.item_features(p)
    got = content.mean_scores(cells, sparse.packed(f))
    want = content.content_profile(cells, f).withColumnRenamed("value", "w").join(f, "feature").groupBy("user_id", "product_id").agg(F.sum(F.col("w") * F.col("value")).alias("want"))
    assert got.join(want, ["user_id", "product_id"]).where("abs(score - want) > 1e-9").count() == 0 and got.count() == want.count()
    with pytest.raises(ValueError):
        content.scores(cells, p, f, aggregate="median")
    with pytest.raises(KeyError):
        content.similar(f, "nope")
    with pytest.raises(KeyError):
        knn.similar(knn.neighbours(knn.similarity(cells)), p, "nope")


def test_fold_equals_plain_updates(spark, world):
    p, e, _ = world
    f = features.item_features(p).cache()
    vectors = {}
    for r in f.collect():
        vectors.setdefault(r.product_id, {})[r.feature] = r.value
    events = e.where("user_id < 'U004' and event_type != 'view'").withColumn("weight", F.lit(2.0))
    want = {}
    for r in events.orderBy("timestamp", "event_id").collect():
        own = want.setdefault(r.user_id, {})
        for k, v in vectors[r.product_id].items():
            own[k] = own.get(k, 0) + 2.0 * v
        n = sum(v * v for v in own.values()) ** 0.5
        for k in own:
            own[k] /= n
    got = {}
    for r in content.fold_event(spark.createDataFrame([], "user_id string, feature string, value double"), f, events).collect():
        got.setdefault(r.user_id, {})[r.feature] = r.value
    assert got.keys() == want.keys() and all(got[u] == pytest.approx(want[u], abs=1e-9) for u in got)


def test_split_leaks_nothing(spark, world):
    _, e, _ = world
    s = temporal_split(e, 5, 2)
    train, val, test = (df.collect() for df in (s.train, s.val, s.test))
    ids = [{r.event_id for r in x} for x in (train, val, test)]
    assert not ids[0] & ids[1] and not ids[0] & ids[2] and not ids[1] & ids[2] and val and test
    assert {r.event_type for r in val + test} <= set(POSITIVE_EVENTS)
    last = {}
    for r in train:
        last[r.user_id] = max(last.get(r.user_id, r.timestamp), r.timestamp)
    assert all(r.timestamp > last[r.user_id] for r in val + test)
    newest = {}
    for r in val:
        newest[r.user_id] = max(newest.get(r.user_id, r.timestamp), r.timestamp)
    assert all(r.timestamp >= newest[r.user_id] for r in test if r.user_id in newest)
    seen = {(r.user_id, r.product_id) for r in train}
    assert not any((r.user_id, r.product_id) in seen for r in val + test)
    counts = {r.user_id: r.n_train for r in s.train_counts.collect()}
    assert min(counts.values()) >= 5
    named = {(r.segment, r.user_id) for r in segments(s.train_counts).collect()}
    assert named == {("all", u) for u in counts} | {("cold_start", u) for u, n in counts.items() if n <= 25} | {("warm", u) for u, n in counts.items() if n >= 60}


@pytest.mark.parametrize("tile", [1024, 7])
def test_embedding_search(spark, tile, monkeypatch):
    monkeypatch.setattr(features, "TILE_VECTORS", tile)
    r = np.random.default_rng(3)
    m = r.normal(size=(40, 5)).round(1)
    m[7] = m[9]
    m[11] = 0
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None)], "vec_id long, embedding array<float>")
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    cosine = (unit @ unit.T).round(6)
    got = {}
    for x in features.embedding_topk(vectors, 4).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.cosine))
    assert sorted(got) == list(range(40))
    for q, own in got.items():
        own.sort()
        want = sorted((-cosine[q, v], v) for v in range(40) if v != q)[:4]
        assert [round(c, 5) for _, _, c in own] == pytest.approx([-w for w, _ in want], abs=2e-5) and [n for n, _, _ in own] == [1, 2, 3, 4]
    assert features.embedding_topk(vectors.limit(0), 3).count() == 0


@pytest.mark.parametrize("weights", [(0.5,), (0.3, 0.9)])
def test_collaborative_blend_matches_numpy(spark, world, weights, monkeypatch):
    monkeypatch.setattr(latent, "CHUNK_NUMBERS", 500)
    p, _, cells = world
    near = knn.neighbours(knn.similarity(cells), 6)
    factors = latent.item_factors(cells, p, n_factors=4)
    ids = sorted(r.product_id for r in p.collect())
    users, items, m = dense(cells)
    v = np.linalg.svd(m)[2][:4].T
    hidden, raw, seen = np.zeros((len(users), len(ids))), np.zeros((len(users), len(ids))), np.zeros((len(users), len(ids)), bool)
    hidden[:, [ids.index(i) for i in items]] = m @ v @ v.T
    for r in knn.scores(cells, near).collect():
        raw[users.index(r.user_id), ids.index(r.product_id)] = r.score
    for r in cells.collect():
        seen[users.index(r.user_id), ids.index(r.product_id)] = True
    unit = lambda x: (x - x.min(axis=1, keepdims=True)) / np.maximum(x.max(axis=1, keepdims=True) - x.min(axis=1, keepdims=True), 1e-300)
    got = hybrid.collaborative_variants(cells, p, near, factors, 12, weights).collect()
    for w in weights:
        total = w * unit(raw) + (1 - w) * unit(hidden)
        for n, u in enumerate(users):
            own = sorted((r.rank, r.product_id, r.score) for r in got if r.user_id == u and r.knn_weight == w)
            order = sorted((-round(total[n, i], 6), ids[i]) for i in range(len(ids)) if not seen[n, i])[:12]
            assert [r for r, _, _ in own] == list(range(1, 13)) and [round(s, 6) for _, _, s in own] == pytest.approx([-s for s, _ in order], abs=2e-6)
    full = hybrid.collaborative_scores(cells, p, near, factors, 0.5)
    assert full.count() == len(users) * len(ids) and full.columns == ["user_id", "product_id", "score"]


def test_exact_and_iterated_factors_agree(spark, world, monkeypatch):
    p, _, cells = world
    def block(df):
        rows = sorted(df.collect())
        return [r.product_id for r in rows], np.array([r.factors for r in rows])

    ids, exact = block(latent.item_factors(cells, p, n_factors=3))
    dense_scores = {(r.user_id, r.product_id): r.score for r in latent.scores(cells, latent.item_factors(cells, p, n_factors=3)).collect()}
    monkeypatch.setattr(latent, "EXACT_ITEMS", 0)
    monkeypatch.setattr(latent, "BLOCK_ITEMS", 16)
    monkeypatch.setattr(latent, "OVERSAMPLE", 2)
    monkeypatch.setattr(latent, "KRYLOV_BLOCKS", 3)
    m = dense(cells)[2]
    for most in (1 << 26, 100):  # held by the driver, then by the tasks
        monkeypatch.setattr(latent, "MAX_BLOCK", most)
        tolerance = 1e-9 if most > 100 else 1e-4
        factors = latent.item_factors(cells, p, n_factors=3, tolerance=tolerance).cache()
        names, found = block(factors)
        assert names == ids and np.allclose(found.T @ found, np.eye(3), atol=1e-9)
        gram = m.T @ m
        assert np.linalg.norm(gram @ found - found @ (found.T @ gram @ found), axis=0).max() <= 2 * tolerance * np.linalg.eigvalsh(gram)[-1]
        assert np.allclose(exact @ exact.T, found @ found.T, atol=1e-6 if most > 100 else 0.03)
        scored = {(r.user_id, r.product_id): r.score for r in latent.scores(cells, factors).collect()}
        assert scored.keys() == dense_scores.keys() and all(abs(x - dense_scores[k]) < (1e-5 if most > 100 else 0.2) for k, x in scored.items())
    with pytest.raises(ValueError):
        latent.factor_block(factors)
    monkeypatch.setattr(latent, "MAX_PASSES", 1)
    monkeypatch.setattr(latent, "MAX_BLOCK", 1 << 26)
    with pytest.raises(RuntimeError):
        latent.item_factors(cells, p, n_factors=3, tolerance=1e-15)


def test_users_with_few_scores_are_padded_and_others_are_not(spark):
    """u1 has one neighbour to be told of, u2 none, u3 plenty."""
    cells = spark.createDataFrame([("u1", "p00", 1.0), ("u2", "p09", 2.0), ("u3", "p01", 1.0), ("u3", "p02", 1.0)], "user_id string, product_id string, value double")
    near = spark.createDataFrame([("p00", "p05", 0.5)] + [("p01", f"p{i:02d}", 0.1 * i) for i in range(3, 8)], "i string, j string, sim double")
    products = spark.createDataFrame([(f"p{i:02d}",) for i in range(10)], "product_id string")
    got = {}
    for r in knn.recommend(cells, products, near, 4).collect():
        got.setdefault(r.user_id, []).append((r.rank, r.product_id, round(r.score, 6)))
    assert sorted(got["u1"]) == [(1, "p05", 1.0), (2, "p01", 0.0), (3, "p02", 0.0), (4, "p03", 0.0)]
    assert sorted(got["u2"]) == [(1, "p00", 0.0), (2, "p01", 0.0), (3, "p02", 0.0), (4, "p03", 0.0)]
    assert [p for _, p, _ in sorted(got["u3"])] == ["p07", "p06", "p05", "p04"]
    some = products.where("product_id in ('p03', 'p05', 'p08')")
    assert {r.user_id: r.n for r in knn.recommend(cells, products, near, 4, some).groupBy("user_id").agg(F.count("*").alias("n")).collect()} == {"u1": 3, "u2": 3, "u3": 3}


def test_scored_hybrid_equals_dense_blend(spark, world, monkeypatch):
    p, _, cells = world
    monkeypatch.setattr(latent, "CHUNK_NUMBERS", 700)
    near, factors = knn.neighbours(knn.similarity(cells), 6), latent.item_factors(cells, p, n_factors=4)
    packs = sparse.packed(features.item_features(p))
    people = cells.select("user_id").distinct()
    members = [
        (0.4, content.scores(cells, p, packs)),
        (0.5, hybrid.collaborative_scores(cells, p, near, factors, 0.3)),
        (0.1, people.join(popularity.popularity_scores(cells, p))),
    ]
    want = rank_topk(hybrid.blended_scores(members), 9, exclude=interactions.seen_items(cells))
    got = hybrid.recommend_scored(cells, p, near, factors, packs, 9, knn_weight=0.3).withColumnRenamed("score", "got")
    met = want.join(got, ["user_id", "product_id", "rank"])
    assert want.count() == got.count() == met.count() and met.where("abs(score - got) > 1e-9").count() == 0
    monkeypatch.setattr(hybrid, "SPARSE_NUMBERS", 10)
    with pytest.raises(ValueError):
        hybrid.recommend_scored(cells, p, near, factors, packs, 9)


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_terms_are_counted_where_their_texts_are(spark):
    rows = [(f"P{i:05d}", "large ring", "d", "c", "s", "b", ["large"]) for i in range(3 * features.TERM_PRODUCTS)]
    products = spark.createDataFrame(rows, "product_id string, title string, description string, category string, subcategory string, brand string, tags array<string>")
    for made in (features.word_terms(products), features.char_terms(products)):
        (moved,) = _exchanges(made)
        assert "term" not in moved and "product_id" in moved
        assert made.rdd.getNumPartitions() == 3
    twice = features.word_terms(products.where("product_id = 'P00007'").unionByName(products.where("product_id = 'P00007'")))
    assert [r.n for r in twice.where("term = 'ring'").collect()] == [2]  # ring stands apart once in a text, the title's seam hides the other


def test_split_moves_events_once(spark):
    rows = [(f"e{u}-{n}", f"u{u}", f"p{n % 7}", "purchase" if n % 3 else "view", n) for u in range(4) for n in range(30)]
    rows += [("x1", None, "p1", "purchase", 1), ("x2", "u1", "p1", None, 99), ("x3", "u2", "p9", "purchase", 40), ("x4", "u9", "p1", "view", 3)]
    events = spark.createDataFrame(rows, "event_id string, user_id string, product_id string, event_type string, timestamp long")
    made = temporal_split(events, 5, 2)
    assert not any(_exchanges(part) for part in (made.train, made.val, made.test))
    got = {name: {r.event_id for r in getattr(made, name).collect()} for name in ("train", "val", "test")}
    want = {"train": set(), "val": set(), "test": set()}
    for u in {r[1] for r in rows if r[1]}:
        own = sorted((r for r in rows if r[1] == u), key=lambda r: (r[4], r[0]))
        held = [r for r in own if r[3] in ("purchase", "wishlist", "add_to_cart")][-5:]
        train = [r for r in own if not held or r[4] < held[0][4]]
        if len(train) >= 5:
            want["train"] |= {r[0] for r in train}
            for n, r in enumerate(held):
                if r[2] not in {t[2] for t in train}:
                    want["val" if n < 2 else "test"].add(r[0])
    assert got == want and want["test"]
    assert {r.user_id: r.n_train for r in made.train_counts.collect()} == {u: sum(r.startswith(f"e{u[1:]}-") for r in got["train"]) for u in ("u0", "u1", "u2", "u3")}


def test_collaborative_lists_beyond_the_block(spark, world, monkeypatch):
    products, events, _ = world
    cells = interactions.interaction_matrix(events, products.where("product_id < 'P020'"))
    near, factors = knn.neighbours(knn.similarity(cells)), latent.item_factors(cells, products, 4)
    n_own = cells.select("product_id").distinct().count()
    rows = lambda k: sorted((r.user_id, r.rank, r.product_id, round(r.score, 9)) for r in hybrid.recommend_collaborative(cells, products, near, factors, k).collect())
    everything = sorted(hybrid.collaborative_scores(cells, products, near, factors).collect(), key=lambda r: (r.user_id, -round(r.score, 9), r.product_id))
    seen = {(r.user_id, r.product_id) for r in cells.collect()}
    want = []
    for u in {r.user_id for r in everything}:
        own = [r for r in everything if r.user_id == u and (u, r.product_id) not in seen][:30]
        want += [(u, n, r.product_id, round(r.score, 9)) for n, r in enumerate(own, 1)]
    monkeypatch.setattr(latent, "MAX_BLOCK", (n_own + 30) * 4)
    assert (n_own + 30) * 4 < products.count() * 4
    assert rows(30) == sorted(want)


def test_vectors_meet_in_few_large_tiles(spark, monkeypatch):
    r = np.random.default_rng(5)
    m = r.normal(size=(3000, 4)).astype(np.float32)
    vectors = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(features, "TILE_COSINES", 100_000)
    found = features.embedding_topk(vectors, 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"Repartition\w+ \[q_block#\d+, v_block#\d+\], (\d+)", plan) == ["1"]
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -2)
    assert {r.query_id: round(r.cosine, 9) for r in found.where("rank = 1").collect()} == {i: pytest.approx(round(c, 9), abs=2e-9) for i, c in enumerate(cosine.max(axis=1))}
