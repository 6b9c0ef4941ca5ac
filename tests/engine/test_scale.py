"""What keeps the driver and the tasks small: plans and tiles, not results."""

import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyrank.files import Folder
from tallyrank.operators import content, fewseen, hybrid, knn, latent, popularity
from tallyrank.operators.ranking import rank_topk
from tallyrank.plans import tuning
from tallyrank.session import SHUFFLE_CLEANUP, broadcast_by_measure, shared_dir, stored


def test_small_file_of_many_rows_is_not_broadcast(spark):
    broadcast_by_measure(spark)
    wide = stored(spark.range(500_000).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("p"), F.array_repeat(F.lit("char:abc"), 9).alias("fs")))
    other = stored(spark.range(500_000).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("p"), F.col("id").alias("n")))
    joined = wide.join(other, "p").select("n", "fs")
    size = wide._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size < 10 << 20
    assert len(joined.collect()) == 500_000
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # A side that turns out to be small still is.
    small = wide.join(stored(other.where("n < 5")), "p").select("n", "fs")
    assert len(small.collect()) == 5
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_content_lists_leave_a_part_cut(spark, monkeypatch):
    """Of a part, k rows a user leave, however many blocks of items have passed; ties go by id across blocks."""
    cells = spark.createDataFrame([(f"u{u}", f"p{u:03d}", 1.0) for u in range(5)], "user_id string, product_id string, value double")
    products = spark.range(60).select(F.format_string("p%03d", "id").alias("product_id"), F.lit(1.0).alias("price"), F.lit(4.0).alias("rating"), F.lit(9).alias("rating_count"))
    packs = products.select("product_id", F.array(F.lit("word:a")).alias("fs"), F.array(F.lit(1.0)).alias("vs"))
    monkeypatch.setattr(content.sparse, "BLOCK_ROWS", 7)
    monkeypatch.setattr(content, "LEAST_PARTS", 1, raising=False)
    monkeypatch.setattr(content, "rank_topk", lambda rows, k: rows)
    got = {}
    for r in content.recommend(cells, products, packs, 3).collect():
        got.setdefault(r.user_id, []).append(r.product_id)
    assert {u: sorted(x) for u, x in got.items()} == {f"u{u}": [p for p in (f"p{n:03d}" for n in range(4)) if p != f"p{u:03d}"][:3] for u in range(5)}


def test_blended_lists_equal_dense_scores(spark, monkeypatch):
    products = spark.range(60).select(F.format_string("p%03d", "id").alias("product_id"), (F.col("id") % 7).alias("price"), (F.col("id") % 5).alias("rating"), (F.col("id") % 11).alias("rating_count"))
    packs = products.where("product_id > 'p004'").select("product_id", F.array(F.lit("word:a"), F.concat(F.lit("word:"), F.col("price").cast("string"))).alias("fs"), F.array(F.lit(0.6), F.lit(0.8)).alias("vs"))
    cells = spark.range(90).select(F.concat(F.lit("u"), (F.col("id") % 9).cast("string")).alias("user_id"), F.format_string("p%03d", F.col("id") * 7 % 60).alias("product_id"), (1 + F.col("id") % 4).cast("double").alias("value")).dropDuplicates(["user_id", "product_id"])
    near = knn.scaled_scores(knn.scores(cells, knn.neighbours(knn.similarity(cells), 4)), spark.sql("select 60L as n"))
    common = popularity.popularity_scores(cells, products)
    people = cells.select("user_id").distinct()
    dense = people.join(products.select("product_id")).join(near, ["user_id", "product_id"], "left").select("user_id", "product_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    members = [(0.4, content.scores(cells, products, packs)), (0.5, dense), (0.1, people.join(common))]
    want = rank_topk(hybrid.blended_scores(members), 8, exclude=cells).collect()
    for name, value in (("TILE_USERS", 4), ("GROUP_ITEMS", 20)):
        monkeypatch.setattr(content, name, value)
    monkeypatch.setattr(content.sparse, "BLOCK_ROWS", 7)
    got = {(r.user_id, r["rank"]): r for r in content.blended(cells, products, packs, near, common, 8, (0.4, 0.5, 0.1)).collect()}
    assert len(got) == len(want) == 72
    assert all(got[r.user_id, r["rank"]].product_id == r.product_id and abs(got[r.user_id, r["rank"]].score - r.score) < 1e-9 for r in want)


def test_slices_give_the_whole_neighbour_table_and_lists(spark, monkeypatch):
    """Large tables are made slice by slice; a slice's shuffles go before the next (F10, F13, F14, F19)."""
    r = random.Random(5)
    history = {u: r.sample(range(40), r.randrange(1, 20)) for u in range(30)}
    history[99] = list(range(40))
    cells = spark.createDataFrame([(f"U{u}", f"P{i:02}", 0.1 + r.random()) for u, items in history.items() for i in items], "user_id string, product_id string, value double").cache()
    products = spark.createDataFrame([(f"P{i:02}",) for i in range(45)], "product_id string")
    rows = lambda df, *keys: {tuple(x[k] for k in keys): (round(x[-2], 9), x[-1]) for x in df.collect()}
    whole = knn.neighbours(knn.similarity(cells), 6)
    want = rows(whole, "i", "j")
    lists = rows(knn.recommend(cells, products, whole, 5), "user_id", "product_id")
    monkeypatch.setattr(knn, "HISTORY_BLOCK", 7)
    monkeypatch.setattr(knn, "PAIRS_HELD", 50)
    monkeypatch.setattr(knn, "PAIRS_A_SLICE", 1000)
    monkeypatch.setattr(knn, "SCORES_A_SLICE", 300)
    near = knn.neighbour_table(cells, 6)
    assert rows(near, "i", "j") == want and len(want) == 240
    assert rows(knn.recommend(cells, products, near, 5), "user_id", "product_id") == lists
    plain = {}
    for i in range(40):
        for j in range(40):
            if i != j:
                plain[f"P{i:02}", f"P{j:02}"] = 0.0
    table = {(x.user_id, x.product_id): x.value for x in cells.collect()}
    length = {u: sum(v * v for (w, _), v in table.items() if w == u) for u in {u for u, _ in table}}
    total = {p: sum(v for (_, q), v in table.items() if q == p) for _, p in table}
    for i, j in plain:
        dot = sum(table[u, i] * table[u, j] / length[u] for u in length if (u, i) in table and (u, j) in table)
        plain[i, j] = dot / (1 + (total[i] + total[j]) / 10)
    assert all(abs(plain[x] - sim) < 1e-8 for x, (sim, _) in want.items())


def test_pairs_and_scores_are_shuffled_once(spark, request):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    cells = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 1.0)], "user_id string, product_id string, value double")
    plan = knn.neighbours(knn.similarity(cells))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert above.count("Exchange") == 1 and "Window" in above and "Join" not in above
    near = spark.createDataFrame([("x", "y", 0.5)], "i string, j string, sim double")
    plan = knn.scores_and_seen(cells, near)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate")]


def test_stored_leaves_no_shuffle_files(spark):
    """They stayed until the driver collected its garbage: the disk of F10, F13, F14, F18 and F19."""
    blocks = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = blocks()
    out = stored(spark.range(0, 1000, 1, 4).repartition(3, "id"))
    for _ in range(50):
        if blocks() <= before:
            break
        time.sleep(0.1)
    assert blocks() <= before and out.count() == 1000
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == "false"


def test_large_factor_block_stays_in_the_tasks(spark, monkeypatch):
    """F8: the driver held the block of all items, its basis and their ids; beyond a small bound only small matrices meet there."""
    r = np.random.default_rng(3)
    m = (r.random((120, 70)) < 0.2) * r.random((120, 70))
    cells = spark.createDataFrame([(f"U{u}", f"P{i:02}", float(m[u, i])) for u, i in zip(*np.nonzero(m), strict=True)], "user_id string, product_id string, value double").cache()
    monkeypatch.setattr(latent, "EXACT_ITEMS", 0)
    monkeypatch.setattr(latent, "DRIVER_NUMBERS", 100, raising=False)
    monkeypatch.setattr(latent, "BLOCK_ITEMS", 16)
    monkeypatch.setattr(latent, "STATE_NUMBERS", 100, raising=False)
    monkeypatch.setattr(latent, "_driver_block", None)
    found = np.array([x.factors for x in latent.item_factors(cells, None, 3, 1e-9).orderBy("product_id").collect()])
    values, vectors = np.linalg.eigh(m[:, m.any(axis=0)].T @ m[:, m.any(axis=0)])
    assert np.allclose(np.abs((found * vectors[:, ::-1][:, :3]).sum(axis=0)), 1, atol=1e-9)


def test_pairs_hold_one_triangle_and_few_items():
    """a table of places was kept for each length of history, and a batch was taken apart whole."""
    a = [[{"product_id": f"P{i}", "r": 1.0} for i in range(n)] for n in (3, 400, 0, 500, 1)]
    kind = pa.list_(pa.struct([("product_id", pa.string()), ("r", pa.float64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(a, kind), pa.nulls(5, kind)], ["a", "b"])
    assert [len(x) for x in (*knn._triangle(3), *knn._triangle(500))] == [6, 6, 125250, 125250]
    kept = {tuple(sorted(x)) for x in zip(*(y.tolist() for y in knn._triangle(3)), strict=True)}
    assert kept == {(0, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 2)}
    assert knn._triangle_of.cache_info().maxsize == 2
    assert [x.num_rows for x in knn._few_items([batch] * 2)] == [5, 5]
    whole = pa.Table.from_batches(knn._pair_sums([batch])).to_pandas().groupby(["i", "j"]).dot.sum().to_dict()
    held, knn.ITEMS_HELD = knn.ITEMS_HELD, 300
    try:
        assert [x.num_rows for x in knn._few_items([batch])] == [1, 2, 2]
        assert pa.Table.from_batches(knn._pair_sums([batch])).to_pandas().groupby(["i", "j"]).dot.sum().to_dict() == whole
    finally:
        knn.ITEMS_HELD = held
    assert len(whole) == 125250 and whole["P0", "P0"] == 4 and whole["P1", "P2"] == 3


def test_entries_are_shuffled_once_for_all_trials(spark):
    """every list entry was copied for each trial before it was shuffled."""
    r = random.Random(9)
    lists = {m: [(f"u{u}", f"p{i:02}", n + 1) for u in range(7) for n, i in enumerate(r.sample(range(30), 12 if u else 0))] for m in "cknp"}
    frame = lambda m: spark.createDataFrame(lists[m], "user_id string, product_id string, rank int")
    collab = frame("k").withColumn("knn_weight", F.lit(0.3)).unionByName(frame("n").withColumn("knn_weight", F.lit(0.7)))
    trials = tuning.grid(spark, (0.3, 0.7))
    broadcast_by_measure(spark)
    users = stored(collab.select("user_id").distinct())
    told = lambda df: stored(df).join(users, "user_id", "left_semi")
    joined = tuning.trial_recommendations(trials, told(frame("c")), told(collab), told(frame("p")), 5)
    assert joined.count() == joined.select("trial", "user_id", "rank").distinct().count() == 42 * 6 * 5
    for table, member in ((collab, {0.3: "k", 0.7: "n"}), (frame("k"), {0.3: "k", 0.7: "k"})):
        recs = tuning.trial_recommendations(trials, frame("c"), table, frame("p"), 5)
        assert "Expand" not in (plan := recs._jdf.queryExecution().executedPlan().toString()) and "Join" not in plan
        got = {(x.trial, x.user_id, x["rank"]): (x.product_id, round(x.score, 12)) for x in recs.collect()}
        want = {}
        for t in trials.collect():
            sums = {}
            for m, w in (("c", t.content_weight), (member[t.knn_weight], t.collab_weight), ("p", t.popularity_weight)):
                for u, i, n in lists[m] if w > 0 else ():
                    sums.setdefault(u, {}).setdefault(i, 0.0)
                    sums[u][i] += w / (60 + n)
            for u, items in sums.items():
                for n, (i, x) in enumerate(sorted(items.items(), key=lambda y: (-round(y[1], 9), y[0]))[:5], 1):
                    want[t.trial, u, n] = (i, round(x, 12))
        assert got == want and len(got) == 42 * 6 * 5


def test_best_of_a_block_is_cut_before_it_is_held():
    """all scores of the first blocks were held with their ids until the first cut."""
    users = type("Users", (), {"names": [f"u{u}" for u in range(200)]})()
    r = np.random.default_rng(1)
    blocks = [np.round(r.random((200, 300)), 2) for _ in range(3)]
    blocks[1][3] = -np.inf
    best, most = content._Best(users, 10), 0
    for n, score in enumerate(blocks):
        best.add([f"p{n * 300 + i:03}" for i in range(300)], score)
        most = max(most, sum(len(x[0]) for x in best.held))
        assert n or most < 10_000  # of 60,000 scores
    got = best.rows().to_pandas().groupby("user_id").product_id.apply(list).to_dict()
    whole = np.hstack(blocks)
    assert got == {f"u{u}": [f"p{i:03}" for i in np.argsort(-whole[u], kind="stable")[:10]] for u in range(200)}


def test_scores_have_tasks_by_their_number(spark, monkeypatch):
    """cells and neighbours met by product, a few popular ones in one task each."""
    cells = spark.range(400).select(F.concat(F.lit("u"), (F.col("id") % 100).cast("string")).alias("user_id"), F.concat(F.lit("p"), F.expr("id div 100").cast("string")).alias("product_id"), F.lit(2.0).alias("value"))
    near = spark.range(4 * 5).select(F.concat(F.lit("p"), (F.col("id") % 4).cast("string")).alias("i"), F.concat(F.lit("q"), F.expr("id div 4").cast("string")).alias("j"), F.lit(0.5).alias("sim"))
    monkeypatch.setattr(knn, "SCORES_A_TASK", 100, raising=False)
    found = knn.scores(cells, near)
    tasks = found.groupBy(F.spark_partition_id().alias("t")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("u")).collect()
    assert len(tasks) > 10 and all(t.n == 5 * t.u for t in tasks)
    assert {x.score for x in found.collect()} == {4.0} and found.count() == 500


def _content_world(spark):
    products = spark.range(75).select(F.format_string("p%03d", "id").alias("product_id"), (F.col("id") % 7).alias("price"), (F.col("id") % 5).alias("rating"), (F.col("id") % 11).alias("rating_count"))
    word = lambda n: F.concat(F.lit("word:"), (F.xxhash64("product_id", F.lit(n)) % 6).cast("string"))
    packs = products.where("product_id > 'p004'").select("product_id", F.array(F.lit("word:a"), word(1), F.concat(F.lit("x"), word(2))).alias("fs"), F.array(F.lit(0.48), F.lit(0.64), F.lit(0.6)).alias("vs"))
    cells = spark.range(120).select(F.concat(F.lit("u"), (F.col("id") % 11).cast("string")).alias("user_id"), F.format_string("p%03d", F.col("id") * 7 % 30).alias("product_id"), (1 + F.col("id") % 4).cast("double").alias("value")).dropDuplicates(["user_id", "product_id"])
    return products, packs, cells.cache()


def _small_blocks(monkeypatch):
    for name, value in (("ITEMS_A_BLOCK", 9), ("USERS_A_BLOCK", 3), ("PAIRS_AT_ONCE", 20)):
        monkeypatch.setattr(fewseen, name, value)


def _same_lists(got, want, n):
    table = lambda df: {(r.user_id, r["rank"]): r for r in df.collect()}
    got, want = table(got), table(want)
    assert got.keys() == want.keys() and len(want) == n
    assert all(got[x].product_id == r.product_id and abs(got[x].score - r.score) < 1e-9 for x, r in want.items())


def test_items_are_not_shuffled_for_each_block_of_users(spark, monkeypatch):
    """Each block of users had the whole catalogue's features shuffled to it (F3, F4, F6, F15 and others)."""
    products, packs, cells = _content_world(spark)
    monkeypatch.setattr(fewseen, "FEW_SEEN", 0)
    want = content.recommend(cells, products, packs, 6).cache()
    terms = content.terms(cells, packs).cache()
    _same_lists(want, want, 66)
    assert terms.count() > 700
    monkeypatch.setattr(fewseen, "FEW_SEEN", 512)
    monkeypatch.setattr(content, "TILE_USERS", 1)
    _small_blocks(monkeypatch)
    got = content.recommend(cells, products, packs, 6)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    _same_lists(got, want, 66)
    met = terms.join(content.terms(cells, packs).selectExpr("user_id", "product_id", "mean m", "best b"), ["user_id", "product_id"])
    assert met.where("abs(best - b) < 1e-9 and (abs(mean - m) < 1e-9 or mean is null and m is null)").count() == terms.count() == content.terms(cells, packs).count()


def test_full_hybrid_has_no_bound_on_the_catalogue(spark, monkeypatch):
    """A catalogue of more than SPARSE_NUMBERS features was refused (F11)."""
    products, packs, cells = _content_world(spark)
    near, factors = knn.neighbours(knn.similarity(cells), 4).cache(), latent.item_factors(cells, products, 3).cache()
    want = hybrid.recommend_scored(cells, products, near, factors, packs, 8, knn_weight=0.3).cache()
    _same_lists(want, want, 88)
    monkeypatch.setattr(hybrid, "SPARSE_NUMBERS", 10)
    _small_blocks(monkeypatch)
    _same_lists(hybrid.recommend_hybrid(cells, products, near, factors, packs, 8, knn_weight=0.3), want, 88)
    # Where every item has been seen by someone, no value stands for the others.
    some = products.join(cells.select("product_id").distinct(), "product_id", "left_semi")
    monkeypatch.setattr(hybrid, "SPARSE_NUMBERS", 1 << 24)
    _same_lists(hybrid.recommend_hybrid(cells, some, near, factors, packs, 4), hybrid.recommend_scored(cells, some, near, factors, packs, 4), 44)


def test_pairs_and_scores_are_packed_not_rows(spark, monkeypatch):
    """Each pair and each product of a cell and a neighbour was a row of strings: the time of F7, F10, F12, F13, F14."""
    r = random.Random(8)
    history = {u: r.sample(range(40), r.randrange(1, 25)) for u in range(25)}
    # Values of old events are tiny, their scores round to zero and rank by id.
    rows = [(f"U{u}", f"P{i:02}", (0.1 + r.random()) * (1e-14 if r.random() < 0.4 else 1)) for u, items in history.items() for i in items]
    cells = spark.createDataFrame(rows, "user_id string, product_id string, value double").cache()
    products = spark.createDataFrame([(f"P{i:02}",) for i in range(50)], "product_id string").cache()
    want = knn.neighbours(knn.similarity(cells), 6).cache()
    plans, stored_table = [], knn.checkpointed
    monkeypatch.setattr(knn, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored_table(df))
    for name, value in (("PAIRS_HELD", 50), ("PAIRS_A_BUCKET", 40), ("SCORES_HELD", 30), ("PAIRS_A_SLICE", 3000), ("SCORES_A_SLICE", 900)):
        monkeypatch.setattr(knn, name, value)
    near = knn.neighbour_table(cells, 6)
    assert not any("Aggregate [i" in x for x in plans)
    key = lambda df: {(x.i, x.j): (round(x.sim, 12), x["rank"]) for x in df.collect()}
    assert key(near) == key(want)
    plans.clear()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        lists = {(x.user_id, x["rank"]): (x.product_id, round(x.score, 9)) for x in knn.recommend(cells, products, near, 5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not any("Generate" in x and "sim" in x for x in plans)
    # With candidates, scores are rows.
    assert lists == {(x.user_id, x["rank"]): (x.product_id, round(x.score, 9)) for x in knn.recommend(cells, products, near, 5, products).collect()}
    assert len(lists) == 125


def test_spread_factors_leave_only_their_result(spark, monkeypatch):
    """Every pass left its tables in the shared folder until the application ended: the disk of F5."""
    r = random.Random(3)
    cells = spark.createDataFrame([(f"U{u}", f"P{i:02}", 0.1 + r.random()) for u in range(9) for i in r.sample(range(8), 4)], "user_id string, product_id string, value double").cache()
    want = {x.product_id: abs(x.factors[0]) for x in latent.item_factors(cells, None, 1).collect()}
    monkeypatch.setattr(latent, "EXACT_ITEMS", 2)
    monkeypatch.setattr(latent, "DRIVER_NUMBERS", 4)
    monkeypatch.setattr(latent, "OVERSAMPLE", 1)
    tables = lambda: set(Folder(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}").names())
    before = tables()
    found = latent.item_factors(cells, None, 1)
    assert len(tables() - before) == 1
    got = {x.product_id: abs(x.factors[0]) for x in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - v) < 1e-6 for p, v in want.items())
