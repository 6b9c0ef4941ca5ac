import re
import threading
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyrank import session
from tallyrank.files import Folder
from tallyrank.operators import catalog, content, features, interactions
from tallyrank.operators.catalog import CatalogFilters
from tallyrank.plans.artifacts import ArtifactStore
from tallyrank.plans.service import ModelNotReadyError, Request, Service
from tallyrank.plans.train import FusionWeights, train
from tallyrank.settings import Settings
from tallyrank.sources import adapters
from tallyrank.sources.schemas import EVENT, PRODUCT, conform
from tallyrank.sources.store import Store
from tallyrank.streaming import profiles

SF = "/root/testdata/sf0.001"
T0 = datetime(2026, 1, 1, tzinfo=UTC)


def test_store_contract(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.counts() == {"products": 0, "users": 0, "events": 0} and store.products().columns == PRODUCT.names
    products = spark.createDataFrame([(f"P{i}", 10.0 * (i + 1), 4.0, i, [f"t{i}"]) for i in range(5)], "product_id string, price double, rating double, rating_count long, tags array<string>")
    events = [(f"E{i}", "U0", f"P{i % 5}", "view", T0 - timedelta(days=i), None, None) for i in range(8)] + [("E9", "U1", "P2", "purchase", T0, 5.0, None), ("bad", None, "P2", "view", T0, None, None)]
    store.upsert_products(products)
    store.upsert_users(spark.createDataFrame([("U0",), ("U1",)], "user_id string"))
    store.insert_events(spark.createDataFrame(events, EVENT))
    store.append_event(spark.createDataFrame(events[:1], EVENT))
    assert store.counts() == {"products": 5, "users": 2, "events": 9}
    rollup = store.user_profile_counts(["U0"]).collect()
    assert len(rollup) == 5 and sum(r.n_events for r in rollup) == 8 and sum(r.weight for r in rollup) == 8
    assert [r.event_id for r in store.events(since="2025-12-30 00:00:00", user_id="U0").collect()] == ["E2", "E1", "E0"]
    store.upsert_products(spark.createDataFrame([("P0", 1.0), ("P7", 2.0)], "product_id string, price double"))
    assert store.counts()["products"] == 6 and store.products().where("product_id = 'P0'").first().price == 1.0
    assert store.users().first().country == "US" and store.products().where("product_id = 'P7'").first().tags == []
    store.clear()
    assert sum(store.counts().values()) == 0


def test_events_are_laid_out_by_day_and_compacted(spark, tmp_path, capsys):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = [(f"E{i:03d}", f"U{i % 7}", "P1", "view", T0 - timedelta(days=i % 20), None, None) for i in range(100)]
    for part in (rows[:40], rows[40:], rows[:3]):
        store.insert_events(spark.createDataFrame(part, EVENT))
    store.events(since="2025-12-28 00:00:00", user_id="U3").explain("formatted")
    plan = capsys.readouterr().out
    assert re.search(r"PartitionFilters: \[.*day#\d+ >= 2025-12-27", plan) and "EqualTo(user_id,U3)" in plan
    want = sorted(r[0] for r in rows if r[4] >= datetime(2025, 12, 28, tzinfo=UTC) and r[1] == "U3")
    assert sorted(r.event_id for r in store.events(since="2025-12-28 00:00:00", user_id="U3").collect()) == want
    before = store._read("events").count()
    store.compact()
    assert (before, store._read("events").count(), store.counts()["events"]) == (103, 100, 100)
    assert sorted(r.event_id for r in store.events(since="2025-12-28 00:00:00", user_id="U3").collect()) == want
    assert [r.product_id for r in store.products().collect()] == []


def test_an_upsert_writes_the_buckets_it_touches(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = lambda price, ids: spark.createDataFrame([(f"P{i}", float(price)) for i in ids], "product_id string, price double")
    store.upsert_products(rows(1, range(200)))
    files = lambda: {p for p in (tmp_path / "store" / "products").rglob("*.parquet")}
    before = files()
    store.upsert_products(rows(2, [7]))
    (new,) = files() - before
    assert new.parent.parent.name.startswith("d-") and {p for p in before} <= files()
    store.upsert_products(rows(3, [7, 8, 500]))
    store.upsert_products(rows(4, [8, 8]))
    got = {r.product_id: r.price for r in store.products().collect()}
    assert len(got) == 201 and (got["P7"], got["P8"], got["P500"], got["P9"]) == (3, 4, 3, 1)
    one = store.product("P8")
    assert one.first().price == 4 and store.product("nope").count() == 0
    assert "PartitionFilters: []" not in one._jdf.queryExecution().executedPlan().toString()
    store.compact()
    assert store._pointer("products")["deltas"] == [] and {r.product_id: r.price for r in store.products().collect()} == got
    monkeypatch.setattr("tallyrank.sources.store.MAX_DELTAS", 2)
    for n in range(4):
        store.upsert_products(rows(10 + n, [1]))
    assert len(store._pointer("products")["deltas"]) == 1 and store.product("P1").first().price == 13


def test_events_in_order_cost_one_shuffle(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    events = [(f"E{i}", f"U{i % 3}", f"P{i % 5}", "view", T0 - timedelta(hours=i % 50), None, None) for i in range(300)]
    store.insert_events(spark.createDataFrame(events, EVENT))
    store.insert_events(spark.createDataFrame(events[:20], EVENT))
    found = store.events()
    rows = [(r.user_id, r.timestamp, r.event_id) for r in found.collect()]
    assert rows == sorted(rows) and len(rows) == 300
    plan = store.events()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
    assert "day" in store.events(since="2025-12-31 00:00:00")._jdf.queryExecution().executedPlan().toString()


def test_a_scope_leaves_other_threads_tables(spark):
    inside, done = threading.Event(), threading.Event()
    kept = []

    def other():
        inside.wait(60)
        kept.append(session.stored(spark.range(5)))
        done.set()

    thread = threading.Thread(target=other)
    thread.start()
    with session.scratch_scope(spark):
        gone = session.stored(spark.range(3))
        inside.set()
        assert done.wait(60) and gone.count() == 3
    thread.join()
    assert kept[0].count() == 5
    with pytest.raises(Exception):
        gone.count()


def test_document_keys_stand_in(spark):
    rows = spark.createDataFrame([("a", None), ("b", "own")], "_id string, product_id string")
    assert sorted(r.product_id for r in conform(rows, PRODUCT).collect()) == ["a", "own"]
    assert [r.event_id for r in conform(spark.createDataFrame([(7,)], "_id int"), EVENT).collect()] == ["7"]


def test_pointers_and_scratch(spark, tmp_path):
    files = Folder(spark, f"file://{tmp_path}/f")
    files.write("a/x", b"1")
    files.write("a/x", b"2")
    assert files.read("a/x") == b"2" and files.names("a") == ["x"] and files.read("none") is None
    with pytest.raises(FileExistsError):
        files.write("a/x", b"3", replace=False)
    assert files.read("a/x") == b"2" and files.names("a") == ["x"]
    with session.scratch_scope(spark):
        inner = session.stored(spark.range(3), "inner")
        path = inner.inputFiles()[0]
        kept = inner.count()
    assert kept == 3 and "scope-" in path and not Path(path.removeprefix("file://")).exists()


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_conform_parses_or_nulls(spark):
    rows = spark.createDataFrame([("a", "x1"), ("b", "2.5")], "product_id string, price string")
    assert [r.price for r in conform(rows, PRODUCT).orderBy("product_id").collect()] == [None, 2.5]


def test_artifacts(spark, tmp_path):
    a = ArtifactStore(spark, f"file://{tmp_path}/art")
    assert a.load() is None and a.load_json("tuning.json") is None
    a.save("one", {"t": spark.range(3)}, {"params": {}})
    a.save("two", {"t": spark.range(5)}, {"params": {}})
    meta, tables = a.load()
    assert meta["version"] == "two" and tables["t"].count() == 5
    a._write("broken.json", "{")
    assert a.load_json("broken.json") is None


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('train')}"
    store, artifacts = Store(spark, f"{root}/store"), ArtifactStore(spark, f"{root}/art")
    service = Service(spark, store, artifacts, Settings(svd_factors=8, knn_top_k=30, eval_top_k=(5, 10), eval_holdout_per_user=3, tuning_val_size=1), reload_s=0)
    with pytest.raises(ModelNotReadyError):
        service.trending()
    with pytest.raises(RuntimeError):
        train(spark, store, artifacts)
    store.upsert_products(adapters.catalogue(spark, SF))
    store.upsert_users(adapters.people(spark, SF))
    store.insert_events(adapters.dense_events(spark, SF))
    version = train(spark, store, artifacts, service.settings)
    return service, version


def test_train_and_serve(spark, trained):
    service, version = trained
    assert service.status()["model_version"] == version and len(version) == 12
    m = service.metrics().collect()
    assert {r.model for r in m} == {"content", "collaborative", "popularity", "hybrid"} and {r.k for r in m} == {5, 10}
    assert all(0 <= r[c] <= 1 for r in m for c in ("precision", "recall", "map", "ndcg", "mrr", "hit_rate", "coverage"))
    tuned = service.tuning()
    assert len(tuned["top_trials"]) == 15 and tuned["best"]["objective"] == max(t["objective"] for t in tuned["top_trials"])
    users = [r.user_id for r in service.model().cells.select("user_id").distinct().orderBy("user_id").limit(2).collect()]
    for strategy in ("content", "collaborative", "popularity", "hybrid"):
        rows = service.recommend(Request([*users, "nobody"], 5, strategy)).collect()
        assert [(r.user_id, r["rank"]) for r in rows] == [(u, i) for u in sorted([*users, "nobody"]) for i in range(1, 6)]
        assert all(r.cold_start == (r.user_id == "nobody") for r in rows)
    only = service.recommend(Request(users, 5, "popularity", filters=CatalogFilters(category="ECONOMY"))).collect()
    assert {r.category for r in only} == {"ECONOMY"}
    first = service.recommend(Request(users[:1], 1, "popularity")).first().product_id
    assert service.recommend(Request(users[:1], 1, "popularity", exclude_product_ids=[first])).first().product_id != first
    assert service.similar("P000000007", 4).count() == 4 and service.trending(3).count() == 3
    for bad in (lambda: Request([]), lambda: Request(["u"], 0), lambda: Request(["u"], strategy="x"), lambda: service.similar("P000000007", strategy="popularity"), lambda: service.record_event("u", "p", "view", datetime(2026, 1, 1))):
        with pytest.raises(ValueError):
            bad()
    for missing in (lambda: service.product("nope"), lambda: service.similar("nope")):
        with pytest.raises(KeyError):
            missing()
    assert service.facets().where("facet = 'brand'").count() > 1 and service.product("P000000007").count() == 1
    service.record_event("fresh", "P000000001", "purchase")
    row = service.profile("fresh").first()
    assert row.n_events == 1 and row.cold_start and service.profile("nobody").count() == 0


def test_a_recorded_event_is_folded_at_once(spark, trained, tmp_path):
    base, _ = trained
    service = Service(spark, base.store, base.artifacts, base.settings, live_path=f"file://{tmp_path}/live")
    with pytest.raises(ValueError):
        base.live()
    model = service.model()
    user = model.cells.orderBy("user_id").first().user_id
    start = {r.feature: r.value for r in content.content_profile(model.cells, model.features).where(F.col("user_id") == user).collect()}
    item = {r.feature: r.value for r in model.features.where("product_id = 'P000000007'").collect()}
    service.record_event(user, "P000000007", "purchase")
    service.record_event(user, "P000000007", "view")
    got = {r.feature: r.value for r in service.live().profiles().collect()}
    want = content.folded(start, [(5.0, item)])
    assert got.keys() == want.keys() and all(abs(got[f] - x) < 1e-9 for f, x in want.items())
    service.live().invalidate([user])
    assert service.live().profiles().count() == 0


def test_stream_equals_batch(spark, tmp_path):
    products, events = adapters.catalogue(spark, SF), adapters.dense_events(spark, SF)
    f = features.item_features(products).cache()
    path = f"{tmp_path}/events"
    ordered = events.orderBy("timestamp").limit(200).cache()
    for n, (low, high) in enumerate([(0, 100), (100, 200)]):
        ordered.orderBy("timestamp").offset(low).limit(high - low).coalesce(1).write.parquet(f"{path}/part{n}")
    ordered.limit(20).coalesce(1).write.parquet(f"{path}/again")
    stream = profiles.live_events(profiles.event_stream(spark, f"{path}/*", recursiveFileLookup="true"), "1000 days")
    q = profiles.profile_stream(stream, f).writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    live = spark.sql("select user_id, feature, max_by(value, n_events) value from live group by user_id, feature")
    once = ordered.where(F.col("event_type").isin(*profiles.FOLDED)).withColumn("weight", F.when(F.col("event_type") == "purchase", 5.0).when(F.col("event_type") == "add_to_cart", 3.0).otherwise(2.0))
    want = content.fold_event(spark.createDataFrame([], "user_id string, feature string, value double"), f, once).withColumnRenamed("value", "want")
    assert live.count() == want.count() and live.join(want, ["user_id", "feature"]).where("abs(value - want) > 1e-9").count() == 0


def test_windowed_counts(spark, tmp_path):
    events = adapters.dense_events(spark, SF)
    events.write.parquet(f"{tmp_path}/e")
    q = profiles.windowed_counts(profiles.event_stream(spark, f"{tmp_path}/e")).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) n from counts").first().n == events.count()


def test_replies_hold_no_number_that_is_none(spark):
    rows = spark.createDataFrame([("a", float("nan"), 1), ("b", float("inf"), 2), ("c", 1.5, None), ("d", None, 4)], "p string, x double, n int")
    assert [(r.x, r.n) for r in catalog.finite(rows).orderBy("p").collect()] == [(None, 1), (None, 2), (1.5, None), (None, 4)]


def test_retrain_reports_its_state(spark, tmp_path):
    service = Service(spark, Store(spark, f"file://{tmp_path}/s"), ArtifactStore(spark, f"file://{tmp_path}/a"), Settings())
    assert service.train_status()["status"] == "idle" and service.health() == {"status": "degraded", "store": True, "model": False}
    assert service.retrain(background=False)["status"] == "failed" and "holds no products" in service.train_status()["message"]
    service._training.acquire()
    assert "busy" in service.retrain()["message"]
    service._training.release()


def test_service_tells_what_it_holds(trained):
    service, _ = trained
    info = service.model_info()
    assert info["n_factors"] == 8 and info["knn_nnz"] > 0 and 0 < info["explained_variance"] <= 1 and service.health()["status"] == "ok"


def test_frames_and_vectors(spark):
    events = spark.createDataFrame([("E1", "u", "p", "view", T0, None, None), ("E2", "u", "q", "purchase", T0 - timedelta(days=7), None, None)], EVENT)
    frame = {r.product_id: r for r in interactions.interaction_frame(events, halflife_days=7).collect()}
    cells = {r.product_id: r.value for r in interactions.interaction_matrix(events, halflife_days=7).collect()}
    assert {p: r.value for p, r in frame.items()} == cells and {r.halflife_days for r in frame.values()} == {7.0}
    assert {r.reference_time.replace(tzinfo=UTC) for r in frame.values()} == {T0}  # the matrix's own, not the clock's
    later = interactions.interaction_frame(events, halflife_days=7, reference="2026-01-08 00:00:00").collect()
    assert all(r.value < cells[r.product_id] for r in later)
    rows = spark.createDataFrame([("a", "word:x", 0.6), ("a", "numeric:y", 0.8), ("b", "char:z", 1.0)], "product_id string, feature string, value double")
    assert features.vectors_for(rows, ["a"]).count() == 2 and tuple(features.feature_counts(rows).first()) == (2, 2)
    with pytest.raises(KeyError):
        features.vectors_for(rows, ["a", "nope"])


def test_fusion_weights():
    assert FusionWeights().as_params() == {"content_weight": 0.4, "collab_weight": 0.5, "popularity_weight": pytest.approx(0.1), "knn_weight": 0.5}
    assert FusionWeights.of_trial({"content_weight": 0.6, "collab_weight": 0.7, "ndcg": 1}).popularity == 0


def test_settings_from_environment(monkeypatch):
    monkeypatch.setenv("TUNING_MAX_USERS", "12")
    monkeypatch.setenv("EVAL_TOP_K", "3,4")
    s = Settings.from_env()
    assert (s.tuning_max_users, s.eval_top_k, Settings().tuning_max_users) == (12, (3, 4), None)


def test_idle_states_expire(spark, tmp_path):
    items = spark.createDataFrame([("P1", "f", 1.0)], "product_id string, feature string, value double")
    path = f"{tmp_path}/events"
    Path(path).mkdir()
    days = [("E1", "U1", 0), ("E2", "U2", 40), ("E3", "U2", 80), ("E4", "U1", 81)]
    found = []
    stream = profiles.profile_stream(profiles.live_events(profiles.event_stream(spark, path, maxFilesPerTrigger="1")), items, idle="10 days")
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda df, _: found.extend(df.collect())).start()
    try:
        for i, (e, u, day) in enumerate(days):
            spark.createDataFrame([(e, u, "P1", "purchase", T0 + timedelta(days=day), 1.0, None)], EVENT).coalesce(1).write.mode("append").parquet(path)
            query.processAllAvailable()
    finally:
        query.stop()
    # When U2 comes again on day 80 the watermark still stands at day 40, so its state is there; U1's went on the way.
    assert [(r.user_id, r.n_events) for r in found] == [("U1", 1), ("U2", 1), ("U2", 2), ("U1", 1)]
