from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyrank.operators import content, features
from tallyrank.operators.content import folded
from tallyrank.sources import adapters
from tallyrank.sources.schemas import EVENT
from tallyrank.streaming.live import LiveProfiles
from tallyrank.streaming.profiles import event_stream

T0 = datetime(2026, 1, 1, tzinfo=UTC)
WEIGHTS = {"add_to_cart": 3.0, "purchase": 5.0, "wishlist": 2.0}


@pytest.fixture(scope="module")
def items(spark):
    made = features.item_features(adapters.catalogue(spark, "/root/testdata/sf0.001").limit(12)).cache()
    held = {}
    for r in made.collect():
        held.setdefault(r.product_id, {})[r.feature] = r.value
    return made, held


def event(n, user, product, kind="purchase", hours=0):
    return (f"E{n}", user, product, kind, T0 + timedelta(hours=hours + n / 60), None, None)


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def told(live, **options):
    out = {}
    for r in live.profiles(**options).collect():
        out.setdefault(r.user_id, {})[r.feature] = r.value
    return out


def same(got, want):
    return got.keys() == want.keys() and all(got[u].keys() == want[u].keys() and all(abs(got[u][f] - v) < 1e-9 for f, v in want[u].items()) for u in want)


def plain(held, rows, start=()):
    """Every event folded in order, from where the user starts."""
    out = {}
    for e in sorted(rows, key=lambda e: (e[4], e[0])):
        if e[3] in WEIGHTS and e[2] in held:
            out[e[1]] = folded(out.get(e[1], dict(start).get(e[1], {})), [(WEIGHTS[e[3]], held[e[2]])])
    return out


def test_a_batch_counts_once_and_events_once(spark, tmp_path, items):
    made, held = items
    ids = sorted(held)
    first = [event(0, "a", ids[0]), event(1, "b", ids[1], "wishlist"), event(2, "a", ids[2], "view"), event(3, "a", "unknown"), (None, "c", ids[0], "purchase", T0, None, None)]
    second = [event(1, "b", ids[1], "wishlist"), event(4, "a", ids[3], "add_to_cart"), event(5, "a", ids[4]), event(5, "a", ids[4])]
    live = LiveProfiles(spark, f"file://{tmp_path}/live", made)
    assert live.apply(frame(spark, first), "one") and same(told(live), plain(held, first[:4]))
    assert not live.apply(frame(spark, first), "one") and not LiveProfiles(spark, f"file://{tmp_path}/live", made).apply(frame(spark, second), "one")
    assert live.apply(frame(spark, second), "two") and same(told(live), plain(held, first[:4] + second[1:3]))
    assert sorted(r.event_id for r in live.events().collect()) == ["E0", "E1", "E2", "E3", "E4", "E5"]
    assert {r.user_id: r.n_events for r in live.profiles().collect()} == {"a": 3, "b": 1}
    before = told(live)
    live.compact()
    assert same(told(live), before) and live.events().count() == 6 and not live.apply(frame(spark, first), "one")
    assert len(live._files.names("commits")) == 1 and len([n for n in live._files.names() if n != "commits"]) == 1
    assert live.apply(frame(spark, []), "empty") and same(told(live), before)


def test_a_failed_batch_leaves_nothing_and_a_rival_is_met(spark, tmp_path, items, monkeypatch):
    made, held = items
    ids = sorted(held)
    live, rival = (LiveProfiles(spark, f"file://{tmp_path}/live", made) for _ in range(2))
    rows, other = [event(0, "a", ids[0])], [event(1, "a", ids[1])]
    commit = live._commit

    def broken(*_, **__):
        raise OSError("lost")

    monkeypatch.setattr(live, "_commit", broken)
    with pytest.raises(OSError):
        live.apply(frame(spark, rows), "one")
    assert told(live) == {} and live.events().count() == 0

    def late(seq, **content):
        monkeypatch.setattr(live, "_commit", commit)
        rival.apply(frame(spark, other), "two")
        commit(seq, **content)

    monkeypatch.setattr(live, "_commit", late)
    assert live.apply(frame(spark, rows), "one")
    # The rival's event came first, as commits go, and both count.
    want = folded(folded({}, [(5.0, held[ids[1]])]), [(5.0, held[ids[0]])])
    assert same(told(live), {"a": want})


def test_profiles_expire_and_are_invalidated(spark, tmp_path, items):
    made, held = items
    ids = sorted(held)
    start = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 1.0)], "user_id string, feature string, value double")
    live = LiveProfiles(spark, f"file://{tmp_path}/live", made, start, keep="2 hours")
    begun = {"a": {"x": 1.0}, "b": {"x": 1.0}}
    rows = [event(n, u, ids[n]) for n, u in enumerate("abc")]
    live.apply(frame(spark, rows), "one")
    want = plain(held, rows, begun.items())
    assert same(told(live), want) and same(told(live, now=T0 + timedelta(hours=1)), want) and told(live, now=T0 + timedelta(hours=3)) == {}
    # An event after the silence starts from the trained profile; one within it goes on.
    live.apply(frame(spark, [event(10, "a", ids[5], hours=5), event(11, "b", ids[6], hours=1)]), "two")
    want |= {"a": folded(begun["a"], [(5.0, held[ids[5]])]), "b": folded(want["b"], [(5.0, held[ids[6]])])}
    assert same(told(live), want)
    live.invalidate(["b", "nobody"])
    assert same(told(live), {u: want[u] for u in "ac"})
    live.apply(frame(spark, [event(20, "b", ids[7], hours=1)]), "three")
    want["b"] = folded(begun["b"], [(5.0, held[ids[7]])])
    assert same(told(live), want)
    live.invalidate()
    assert told(live) == {}
    live.compact()
    live.apply(frame(spark, [event(21, "c", ids[8], hours=1), event(0, "a", ids[0])]), "four")
    assert same(told(live), {"c": folded({}, [(5.0, held[ids[8]])])})  # a's old event is known


def test_a_stream_appends_and_folds(spark, tmp_path, items):
    made, held = items
    ids = sorted(held)
    rows = [event(n, "abc"[n % 3], ids[n % 5], ("purchase", "view", "add_to_cart")[n % 3]) for n in range(30)]
    source = f"file://{tmp_path}/source"
    live = LiveProfiles(spark, f"file://{tmp_path}/live", made)
    for part in (rows[:20], rows[15:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        live.stream(event_stream(spark, source), "s", f"file://{tmp_path}/checkpoint").awaitTermination()
    assert same(told(live), plain(held, rows)) and live.events().count() == 30
    assert live.profiles().select("user_id").distinct().count() == 2
    # The whole stream delivered again, as after a lost checkpoint: the same batches, then nothing.
    live.stream(event_stream(spark, source, maxFilesPerTrigger="1"), "s", f"file://{tmp_path}/other").awaitTermination()
    assert same(told(live), plain(held, rows)) and live.events().count() == 30


def test_equals_the_batch_fold(spark, tmp_path, items):
    made, _ = items
    known = adapters.dense_events(spark, "/root/testdata/sf0.001").where("user_id < 'U000000006'")
    live = LiveProfiles(spark, f"file://{tmp_path}/live", made)
    live.apply(known, "all")
    steps = known.where("event_type in ('wishlist', 'add_to_cart', 'purchase', 'rating')").withColumn("weight", F.expr("case event_type when 'wishlist' then 2.0 when 'add_to_cart' then 3.0 else 5.0 end"))
    want = content.fold_event(spark.createDataFrame([], "user_id string, feature string, value double"), made, steps)
    assert want.count() == live.profiles().count() == live.profiles().join(want.withColumnRenamed("value", "w"), ["user_id", "feature"]).where("abs(value - w) < 1e-9").count() > 0
