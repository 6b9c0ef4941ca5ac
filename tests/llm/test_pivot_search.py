import numpy as np
from pyspark.sql import functions as F

from tallyrank.llm import pivot_search
from tallyrank.llm.pivot_search import PivotIndex, top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, asked, k):
    kept = {(i, tuple(int(np.floor(float(np.float32(x)) * 256)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q, a in kept:
        if q in asked:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def found(df):
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()}


def test_against_brute_force_on_clusters_and_copies(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] * (1 + i % 3) + 0.1 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(200)]  # a third of all rows are one vector
    vectors = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    asked = vectors.where("vec_id % 10 = 0")
    want = slow(rows, {i for i, _ in rows if i % 10 == 0}, 5)
    for settings in ({}, {"pivots": 5, "rings": 3, "tile_rows": 16}):
        assert found(PivotIndex(vectors, **settings).search(asked)) == want
    assert found(PivotIndex(vectors).search(asked, 1)) == {r for r in want if r[1] == 1}


def test_bounds_skip_annuli_and_small_seeds_are_exact(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "SEED_ROWS", 1)
    monkeypatch.setattr(pivot_search, "CHUNK_ROWS", 7)
    rng = np.random.default_rng(2)
    centres = 4 * rng.normal(size=(12, 6))
    rows = [(i, (centres[i % 12] + 0.02 * rng.normal(size=6)).astype(np.float32).tolist()) for i in range(240)]
    vectors = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    index = PivotIndex(vectors, pivots=12, rings=4)
    asked = vectors.where("vec_id % 4 = 0")
    assert found(index.search(asked)) == slow(rows, {i for i, _ in rows if i % 4 == 0}, 5)
    # Whatever the radius, nothing within it is left out, and annuli beyond it are.
    held = {r.vec_id: np.array(r.v, float) for r in pivot_search.quantized(vectors).collect()}
    place = {i: (r.pivot, r.ring) for r in index.tiles.collect() for i in r.v_ids}
    chunks = index._chunks(asked)
    distance = {q: {i: np.sqrt(v @ v + index.most - 2 * held[q] @ v + held[q] @ held[q] - v @ v) for i, v in held.items()} for q in held if q % 4 == 0}
    radius = float(np.quantile([d for x in distance.values() for d in x.values()], 0.05))
    taken = {q: set() for q in distance}
    whole = {(r.own, r.chunk): r.q_ids for r in chunks.collect()}
    for plan in (index._plan(chunks, 5, False), index._plan(chunks.withColumn("radius", F.transform("q_ids", lambda _: F.lit(radius))), 5, True)):
        for r in plan.collect():
            for n in r.who:
                assert (r.pivot, r.ring) not in taken[whole[r.own, r.chunk][n]]
                taken[whole[r.own, r.chunk][n]].add((r.pivot, r.ring))
    met = {(q, i) for q in distance for i in held if place[i] in taken[q]}
    assert {(q, i) for q, x in distance.items() for i, d in x.items() if d <= radius} <= met
    assert len(met) < 0.6 * len(distance) * len(held)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5]), (2, [0.5, -0.5]), (2, [0.5, -0.5]), (3, None), (None, [1.0, 1.0]), (4, [nan, 0.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (7, [0.1]), (8, []), (9, [-3.0, 2.0, 1.0])]
    clash = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA + ", v string, pivot int")
    assert found(top_k(clash, clash)) == slow(rows, {1, 2, 7, 8, 9}, 5)
    none = spark.createDataFrame([], SCHEMA)
    assert top_k(none, none).count() == 0 and top_k(none, clash).count() == 0 and top_k(clash, none).count() == 0
    one = spark.createDataFrame([(1, [0.5], 0)], SCHEMA)
    assert top_k(one, one).count() == 0
    # A query that the table doesn't hold, longer than its vectors.
    other = spark.createDataFrame([(100, [1.0, 0.0, 0.0, 5.0], 0)], SCHEMA)
    got = found(top_k(clash, other, 2))
    assert got == {(100, 1, 1, 128 * 256), (100, 2, 2, 128 * 256)}


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**22 + i), float(2**21 - i)]) for i in range(6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(top_k(vectors, vectors, 3)) == {r for r in slow_double(rows, 3)}


def slow_double(rows, k):
    kept = [(i, [int(x * 256) for x in v]) for i, v in rows]
    for q, a in kept:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q)
        yield from ((q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k]))
