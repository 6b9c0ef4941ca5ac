"""Exact top-k by integer inner product over a pivot-distance index.

Inner products become distances by one more component: with M the largest squared length,
v' = (v, sqrt(M - |v|^2)) and q' = (q, 0) have |q' - v'|^2 = |q|^2 + M - 2 q.v, so the best
scores are the nearest vectors. Each vector is keyed by its nearest pivot and its distance
to it; a pivot's vectors lie in annuli, rings of equal width that are cut into tiles of
bounded size. A vector in the annulus [low, high] of pivot p is at least
max(low - d(q, p), d(q, p) - high) from a query, and, as p is its nearest pivot, at least
(d(q, p) - d(q, nearest)) / 2.

A query expands its annuli in the order of their bounds until they hold SEED_ROWS vectors.
The distance of its k-th best so far is its radius; it then takes every further annulus whose
bound is within the radius and stops: no other can hold a better vector, or an equal one.
Queries of one nearest pivot are searched in chunks, a chunk against a tile in one matrix
product, of which only the best k of a query leave the task.

Pivots are chosen from a bounded sample; they decide how much is skipped and never what is
found. A row is written for each chunk and tile that the chunk's queries can't skip. In many dimensions
without clusters that is most of them: these bounds, like any other, then skip little.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K = 5
SCALE = 256
#: Pivots, the vectors they are chosen from, and the rings of a pivot.
PIVOTS = 64
PIVOT_SAMPLE = 4096
RINGS = 16
#: Vectors of a tile, queries of a chunk.
TILE_ROWS = 4096
CHUNK_ROWS = 1024
#: Vectors that a query meets before it has a radius.
SEED_ROWS = 2048
#: Bounds are compared with this slack, far above what double arithmetic loses.
SLACK = 1e-6


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component.

    Rows without vec_id, null vectors and those with a null, NaN or infinite component take
    no part; equal rows count once.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("v")).distinct()


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows as longs; a short vector's missing components count as zero."""
    lengths = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten())
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: by the fast product of doubles where all sums are exact in them."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def choose_pivots(sample: np.ndarray, n: int = PIVOTS, seed: int = 0) -> np.ndarray:
    """Centres of the sample's rows: a few rounds of nearest-centre means from random distinct rows."""
    rows = np.unique(sample, axis=0).astype(np.float64)
    if len(rows) <= n:
        return rows
    centres = rows[np.random.default_rng(seed).choice(len(rows), n, replace=False)]
    for _ in range(8):
        near = _distances(rows, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        n_near = np.bincount(near, minlength=n)[:, None]
        centres = np.where(n_near > 0, sums / np.maximum(n_near, 1), centres)
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0))


class PivotIndex:
    """The stored tiles of a table of vectors; build it once, search it with any queries."""

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS, rings: int = RINGS, tile_rows: int = TILE_ROWS, scale: int = SCALE):
        self.scale, self.spark = scale, vectors.sparkSession
        held = stored(quantized(vectors, scale), "quantized")
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        facts = held.agg(F.max(square), F.max(F.size("v")), F.count("*")).first()
        self.most, self.width, self.n = facts[0] or 0.0, facts[1] or 0, facts[2]
        # A bounded sample: the first PIVOT_SAMPLE rows by a hash.
        drawn = [r.v for r in held.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PIVOT_SAMPLE).select("v").collect()]
        self.pivots = choose_pivots(_raised(_matrix(pa.array(drawn, pa.list_(pa.int64())), self.width), self.most), pivots)
        keyed = stored(self._keyed(held), "keyed") if self.n else held.select("*", F.lit(0).alias("pivot"), F.lit(0.0).alias("distance"))
        width = max((keyed.agg(F.max("distance")).first()[0] or 0.0) / rings, 1e-9)
        keyed = keyed.withColumn("ring", F.least(F.floor(F.col("distance") / width), F.lit(rings - 1)).cast("int"))
        # A table of pivots * rings rows at most. Equal vectors share a ring, which is cut by a hash of the id.
        sizes = keyed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"))
        self.annuli = [np.array(x) for x in zip(*sorted(map(tuple, sizes.collect())), strict=True)] or [np.zeros(0)] * 5
        cut = keyed.join(F.broadcast(sizes.select("pivot", "ring", F.ceil(F.col("n") / tile_rows).cast("int").alias("parts"))), ["pivot", "ring"])
        whole = F.slice(F.concat("v", F.array_repeat(F.lit(0).cast("long"), self.width)), 1, self.width)
        rows = cut.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).groupBy("pivot", "ring", "part").agg(F.collect_list(F.struct("vec_id", whole.alias("v"))).alias("rows"))
        self.tiles = stored(rows.select("pivot", "ring", "part", F.col("rows.vec_id").alias("v_ids"), F.flatten("rows.v").alias("v_flat")), "tiles")

    def _keyed(self, held: DataFrame) -> DataFrame:
        """(vec_id, v, pivot, distance): the nearest pivot and the distance to it."""
        pivots, width, most = self.pivots, self.width, self.most

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = _distances(_raised(_matrix(batch.column("v"), width), most), pivots)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(d.argmin(axis=1), pa.int32()), pa.array(d.min(axis=1))], ["vec_id", "v", "pivot", "distance"])

        return held.mapInArrow(run, "vec_id long, v array<long>, pivot int, distance double")

    def _chunks(self, queries: DataFrame) -> DataFrame:
        """(own, chunk, ids, flat): queries by their nearest pivot, in chunks by a hash of the id."""
        pivots, width = self.pivots, self.width

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = _matrix(batch.column("v"), width)
                own = _distances(np.column_stack([m, np.zeros(len(m))]), pivots).argmin(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * width, pa.int32()), pa.array(m.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists, pa.array(own, pa.int32())], ["vec_id", "v", "own"])

        # Components beyond the index's width meet nothing but zeros.
        cut = quantized(queries, self.scale).select("vec_id", F.slice("v", 1, self.width).alias("v"))
        found = stored(cut.mapInArrow(run, "vec_id long, v array<long>, own int"), "asked")
        sizes = found.groupBy("own").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("parts"))  # a row for each pivot
        named = found.join(F.broadcast(sizes), "own").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
        rows = named.groupBy("own", "chunk").agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
        return stored(rows.select("own", "chunk", F.col("rows.vec_id").alias("q_ids"), F.flatten("rows.v").alias("q_flat")), "chunks")

    def _plan(self, chunks: DataFrame, k: int, radii: bool) -> DataFrame:
        """(own, chunk, pivot, ring, who): the annuli that queries (places in their chunk) take.

        Without radii, the first by bound; with the column radius, a number for each query, all
        others within it.
        """
        pivots, width, (pivot, ring, n, low, high) = self.pivots, self.width, self.annuli
        pivot, ring = pivot.astype(np.int32), ring.astype(np.int32)
        enough = max(SEED_ROWS, k + 1)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    m = np.asarray(batch.column("q_flat")[r].values).reshape(-1, width) if width else np.zeros((len(batch.column("q_ids")[r]), 0))
                    d = _distances(np.column_stack([m, np.zeros(len(m))]), pivots)
                    met = d[:, pivot]
                    bound = np.maximum(np.maximum(low - met, met - high), np.maximum((met - d.min(axis=1)[:, None]) / 2, 0))
                    order = np.argsort(bound, axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    taken = np.empty(bound.shape, bool)
                    np.put_along_axis(taken, order, before < enough, axis=1)
                    if radii:
                        taken = ~taken & (bound <= np.asarray(batch.column("radius")[r].values)[:, None] * (1 + SLACK) + SLACK)
                    used = np.flatnonzero(taken.any(axis=0))
                    who = pa.array([np.flatnonzero(taken[:, a]).astype(np.int32) for a in used], pa.list_(pa.int32()))
                    key = [batch.column(c)[r].as_py() for c in ("own", "chunk")]
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(used), x, np.int32)) for x in key), pa.array(pivot[used]), pa.array(ring[used]), who], ["own", "chunk", "pivot", "ring", "who"])

        return chunks.mapInArrow(run, "own int, chunk int, pivot int, ring int, who array<int>")

    def _best(self, chunks: DataFrame, plan: DataFrame, k: int) -> DataFrame:
        """(own, chunk, q, query_id, vec_id, score): each query's best k of every tile of its planned annuli."""
        width = self.width
        pairs = plan.join(chunks.select("own", "chunk", "q_ids", "q_flat"), ["own", "chunk"]).join(self.tiles, ["pivot", "ring"])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    who, q_ids, q_flat, v_ids, v_flat = (np.asarray(batch.column(c)[r].values) for c in ("who", "q_ids", "q_flat", "v_ids", "v_flat"))
                    order = np.argsort(v_ids, kind="stable")
                    v_ids = v_ids[order]
                    score = _products(q_flat.reshape(len(q_ids), width)[who], v_flat.reshape(len(v_ids), width)[order])
                    other = q_ids[who][:, None] != v_ids[None, :]
                    least = np.iinfo(np.int64).min
                    best = np.argsort(-np.where(other, score, least + 1), axis=1, kind="stable")[:, :k]
                    keep = np.take_along_axis(other, best, axis=1).ravel()
                    q = np.repeat(who, best.shape[1])[keep]
                    key = [batch.column(c)[r].as_py() for c in ("own", "chunk")]
                    values = [*(pa.array(np.full(len(q), x, np.int32)) for x in key), pa.array(q), pa.array(q_ids[q]), pa.array(v_ids[best].ravel()[keep]), pa.array(np.take_along_axis(score, best, axis=1).ravel()[keep])]
                    yield pa.RecordBatch.from_arrays(values, ["own", "chunk", "q", "query_id", "vec_id", "score"])

        return pairs.select("own", "chunk", "who", "q_ids", "q_flat", "v_ids", "v_flat").mapInArrow(run, "own int, chunk int, q int, query_id long, vec_id long, score long")

    def search(self, queries: DataFrame, k: int = K) -> DataFrame:
        """(query_id, rank, vec_id, score): each query's k best of the other ids, ties to the smaller vec_id.

        queries (vec_id, embedding) follow the rules of quantized(). No row with the query's
        own vec_id is listed. Fewer than k others: all of them. Scores are exact as far as they fit in a long.
        """
        if not self.n:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        chunks = self._chunks(queries)
        seeds = stored(_ranked(self._best(chunks, self._plan(chunks, k, False), k), k), "seeds")
        worst = seeds.groupBy("own", "chunk", "q").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        places = chunks.select("own", "chunk", F.posexplode("q_ids").alias("q", "id"), F.col("q_flat")).select("own", "chunk", "q", F.slice("q_flat", F.col("q") * self.width + 1, F.lit(self.width)).alias("v"))
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        # Fewer than k so far: no bound yet, so all annuli are taken.
        radius = F.coalesce(F.sqrt(F.greatest(square + self.most - 2 * F.col("least").cast("double"), F.lit(0.0))), F.lit(float("inf")))
        radii = places.join(worst, ["own", "chunk", "q"], "left").groupBy("own", "chunk").agg(F.array_sort(F.collect_list(F.struct("q", radius.alias("radius")))).alias("x"))
        bounded = chunks.join(radii.select("own", "chunk", F.col("x.radius").alias("radius")), ["own", "chunk"])
        rest = self._best(chunks, self._plan(bounded, k, True), k)
        return _ranked(seeds.drop("rank").unionByName(rest), k).select("query_id", "rank", "vec_id", "score")


def _raised(m: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the component that brings all to one length."""
    return np.column_stack([m, np.sqrt(np.maximum(most - (m.astype(np.float64) ** 2).sum(axis=1), 0))])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("own", "chunk", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """PivotIndex(vectors).search(queries, k)."""
    return PivotIndex(vectors).search(queries, k)
