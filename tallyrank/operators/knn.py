"""Item neighbours from shared users.

sim(i, j) adds up, over users, the product of their two cells divided by the square of the
user's row norm. Pairs are made in tiles of bounded size however long a history is. For similarity
they are shrunk where they are made and go to their row i, both ways round, so they are shuffled
once. Large tables are made and scored slice by slice (of items, then of users): what a slice
shuffles is removed before the next. There items are numbers in order of their ids, pairs and neighbours travel as
packed arrays, and numpy adds them up and ranks them: one row a block of pairs or a cell, not one a pair or a score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .interactions import item_popularity, minmax_per_user, seen_items
from .ranking import numbered, padded, rank_topk

#: Candidates up to this many are sent to the scores; more are met by a shuffle.
BROADCAST_ITEMS = 100_000
#: Items of a history that are paired at once, and pairs that a task adds up before it passes them on.
HISTORY_BLOCK = 512
PAIRS_HELD = 1 << 20
#: Items of tiles that are taken out of a batch at once.
ITEMS_HELD = 1 << 16
#: Pairs, and products of cells and neighbours, that are shuffled at once: some 2 GB.
PAIRS_A_SLICE = 1 << 27
SCORES_A_SLICE = 1 << 27
#: Pairs of a bucket of items that one task adds up, on average, and products that it adds up at once.
PAIRS_A_BUCKET = 1 << 20
SCORES_HELD = 1 << 20
#: Products of cells and neighbours that a task of scores() adds up: some 100 MB.
SCORES_A_TASK = 1 << 20
#: Tiles of long histories that a task gets, on average.
TILES_A_TASK = 4


def _history_tiles(rows: DataFrame, columns: tuple[str, ...] = ("product_id", "r")) -> DataFrame:
    """(a, b): the items of every history against themselves (b null), and, of histories of several blocks, each block against each later one.

    rows (user_id, n, columns) has each history's length n. A block holds HISTORY_BLOCK items
    or so, so a history of any length is many small tiles.
    """
    blocks = rows.withColumn("of", F.ceil(F.col("n") / HISTORY_BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("product_id"), F.col("of")).cast("int"))
    held = blocks.groupBy("user_id", "of", "block").agg(F.collect_list(F.struct(*columns)).alias("a"))
    long = checkpointed(held.where("of > 1"))
    itself = held.select("a", F.lit(None).cast(held.schema["a"].dataType).alias("b"))
    n_tiles = long.agg(F.sum(F.col("of") - 1 - F.col("block"))).first()[0]
    if not n_tiles:
        return itself
    later = long.where("block < of - 1").select("user_id", F.col("block").alias("first"), F.explode(F.sequence(F.col("block") + 1, F.col("of") - 1)).alias("block"), "a")
    crossed = later.join(long.select("user_id", "block", F.col("a").alias("b")), ["user_id", "block"])
    # Dealt anew, by tile: the join leaves those that share a block in one task.
    return itself.unionByName(crossed.repartition(min(-(-n_tiles // TILES_A_TASK), 10_000), "user_id", "first", "block").select("a", "b"))


def _pair_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, dot) of tiles, pairs added up before they leave the task."""
    for batch in _few_items(batches):
        sides = [batch.column(c) for c in ("a", "b")]
        every = pa.concat_arrays([x.flatten().field("product_id") for x in sides]).dictionary_encode()
        names = np.array(every.dictionary.to_pylist(), object)
        order = np.argsort(names)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        code = rank[np.asarray(every.indices)] if len(names) else np.zeros(0, np.int64)
        value = np.concatenate([np.asarray(x.flatten().field("r"), np.float64) for x in sides])
        sizes = [np.asarray(x.value_lengths().fill_null(0)) for x in sides]
        ends = [np.concatenate([[0], np.cumsum(s)]) for s in sizes]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = 0

        def added() -> pa.RecordBatch:
            pair, where = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            dot = np.bincount(where, np.concatenate([d for _, d in held]))
            i, j = (pa.array(names[order[x]], pa.string()) for x in np.divmod(pair, len(names)))
            held.clear()
            return pa.RecordBatch.from_arrays([i, j, pa.array(dot)], ["i", "j", "dot"])

        for t in range(batch.num_rows):
            a = slice(ends[0][t], ends[0][t + 1])
            if sides[1][t].is_valid:
                b = slice(ends[0][-1] + ends[1][t], ends[0][-1] + ends[1][t + 1])
                x, y = (z.ravel() for z in np.meshgrid(code[a], code[b], indexing="ij"))
                dot = np.outer(value[a], value[b]).ravel()
            else:
                p, q = _triangle(a.stop - a.start)
                x, y, dot = code[a][p], code[a][q], value[a][p] * value[a][q]
            held.append((np.minimum(x, y) * len(names) + np.maximum(x, y), dot))
            n_held += len(dot)
            if n_held >= PAIRS_HELD:
                yield added()
                n_held = 0
        if held:
            yield added()


def _few_items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same tiles in batches of ITEMS_HELD items or one tile, to bound what Python holds beside the pairs."""
    for batch in batches:
        n = sum(np.asarray(batch.column(c).value_lengths().fill_null(0)).astype(np.int64) for c in ("a", "b"))
        nth = np.cumsum(n) // ITEMS_HELD
        cuts = [0, *(np.flatnonzero(np.diff(nth)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                yield batch.slice(a, b - a)


def _triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of n places, as the beginning of the pairs of more places: one table serves all lengths of histories."""
    size = max(HISTORY_BLOCK, 1 << int(n - 1).bit_length()) if n else 1
    return tuple(x[: n * (n + 1) // 2] for x in _triangle_of(size))


@lru_cache(2)
def _triangle_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(x.astype(np.int32) for x in np.tril_indices(n))


def _unit_rows(cells: DataFrame, normalise: bool) -> DataFrame:
    lengths = cells.groupBy("user_id").agg(F.count("*").alias("n"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))
    value = F.col("value") / F.col("length") if normalise else F.col("value")
    return cells.select("user_id", "product_id", "value").join(lengths, "user_id").select("user_id", "product_id", value.alias("r"), "n")


def cooccurrence(cells: DataFrame, normalise: bool = True) -> DataFrame:
    """(i, j, dot) with i <= j over user rows of unit length (or as they are).

    Pairs are made tile by tile and added up inside the task, so they are shuffled once as sums.
    """
    return _history_tiles(_unit_rows(cells, normalise)).mapInArrow(_pair_sums, "i string, j string, dot double").groupBy("i", "j").agg(F.sum("dot").alias("dot"))


def similarity(cells: DataFrame, shrink: float = 10.0, of: int = 1, nth: int = 0) -> DataFrame:
    """(i, j, sim) of all pairs of different items with sim above zero, both ways round, laid out by i; of several slices of i the nth."""
    rows, columns = _unit_rows(cells, True), ("product_id", "r")
    if shrink > 0:
        rows, columns = rows.join(item_popularity(cells), "product_id"), (*columns, "total")
    return _similarity(_history_tiles(rows, columns), shrink, of, nth)


def _similarity(tiles: DataFrame, shrink: float, of: int, nth: int) -> DataFrame:
    found = tiles.mapInArrow(_directed_sums(shrink, of, nth), "i string, j string, sim double")
    return found.repartition("i").groupBy("i", "j").agg(F.sum("sim").alias("sim")).where("sim > 0")


def _directed_sums(shrink: float, of: int, nth: int):
    """(i, j, sim) of tiles, shrunk and added up before they leave the task; i from the nth slice of items."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_items(batches):
            sides = [batch.column(c) for c in ("a", "b")]
            flat = [x.flatten() for x in sides]
            every = pa.concat_arrays([x.field("product_id") for x in flat]).dictionary_encode()
            names, code = every.dictionary, np.asarray(every.indices).astype(np.int64)
            mine = np.fromiter((crc32(x.encode()) % of == nth for x in names.to_pylist()), bool, len(names))[code]
            value = np.concatenate([np.asarray(x.field("r"), np.float64) for x in flat])
            total = np.concatenate([np.asarray(x.field("total"), np.float64) for x in flat]) if shrink > 0 else None
            ends = [np.concatenate([[0], np.cumsum(np.asarray(x.value_lengths().fill_null(0)))]) for x in sides]
            held: list[tuple[np.ndarray, np.ndarray]] = []
            n_held = 0

            def added() -> pa.RecordBatch:
                pair, where = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)  # noqa: B023
                sim = np.bincount(where, np.concatenate([d for _, d in held]))  # noqa: B023
                i, j = np.divmod(pair, len(names))  # noqa: B023
                held.clear()  # noqa: B023
                return pa.RecordBatch.from_arrays([names.take(pa.array(i)), names.take(pa.array(j)), pa.array(sim)], ["i", "j", "sim"])  # noqa: B023

            for t in range(batch.num_rows):
                a = np.arange(ends[0][t], ends[0][t + 1])
                b = np.arange(ends[1][t], ends[1][t + 1]) + ends[0][-1]
                for p, q in ((a, b), (b, a)) if sides[1][t].is_valid else ((a, a),):
                    p = p[mine[p]]
                    sim = np.outer(value[p], value[q])
                    if shrink > 0:
                        sim /= 1 + np.add.outer(total[p], total[q]) / shrink
                    other = code[p][:, None] != code[q]
                    held.append(((code[p][:, None] * len(names) + code[q])[other], sim[other]))
                    n_held += len(held[-1][1])
                if n_held >= PAIRS_HELD:
                    yield added()
                    n_held = 0
            if n_held:
                yield added()

    return run


def _mirrored(cells: DataFrame, shrink: float) -> DataFrame:
    """similarity() for few items: half the pairs are made, and their few sums are shrunk and mirrored."""
    half = cooccurrence(cells).where("i < j")
    if shrink > 0:
        n = item_popularity(cells)
        half = half.join(n.select(F.col("product_id").alias("i"), F.col("total").alias("ni")), "i").join(n.select(F.col("product_id").alias("j"), F.col("total").alias("nj")), "j")
        half = half.select("i", "j", (F.col("dot") / (1 + (F.col("ni") + F.col("nj")) / shrink)).alias("sim"))
    else:
        half = half.withColumnRenamed("dot", "sim")
    half = half.where("sim > 0")
    return half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "sim"))


def _places(items: DataFrame) -> DataFrame:
    """(product_id, place): items numbered from 0 in order of their ids, stored."""
    return checkpointed(numbered(items.select("product_id").distinct().withColumn("score", F.lit(0.0))).select("product_id", (F.col("place") - 1).alias("place")))


def _partners(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(place, r, total, row, first, many): the tiles' items, and each item (row) that meets the many from first on."""
    sides = [batch.column(c) for c in ("a", "b")]
    flat = [x.flatten() for x in sides]
    values = [np.concatenate([np.asarray(x.field(f)) for x in flat]) for f in ("product_id", "r", "total")]
    sizes = [np.asarray(x.value_lengths().fill_null(0)).astype(np.int64) for x in sides]
    ends = [np.concatenate([[0], np.cumsum(n)]) for n in sizes]
    first_a, first_b = ends[0][:-1], ends[1][:-1] + ends[0][-1]
    alone = sizes[1] == 0
    of_a = np.repeat(np.arange(batch.num_rows), sizes[0])
    of_b = np.repeat(np.arange(batch.num_rows), sizes[1])
    first = np.concatenate([np.where(alone, first_a, first_b)[of_a], first_a[of_b]])
    many = np.concatenate([np.where(alone, sizes[0], sizes[1])[of_a], sizes[0][of_b]])
    return *values, np.arange(len(first)), first, many


def _pairs_of(row: np.ndarray, first: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their partners, about PAIRS_HELD at a time."""
    total = np.cumsum(many)
    at = 0
    while at < len(row):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_HELD, side="right")))
        n = many[at:end]
        before = np.concatenate([[0], np.cumsum(n)[:-1]])
        yield np.repeat(row[at:end], n), np.repeat(first[at:end] - before, n) + np.arange(n.sum())
        at = end


def _summed_by(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[starts], np.add.reduceat(value[order], starts) if len(key) else np.zeros(0)


def _bucketed_sums(shrink: float, n_items: int, n_buckets: int, of: int, nth: int):
    """(b, i, j, sim): pairs of tiles, shrunk and added up, packed by buckets of i; i from the nth slice of items."""
    wide = -(-n_items // (of * n_buckets))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_items(batches):
            place, r, total, row, first, many = _partners(batch)
            place = place.astype(np.int64)
            if of > 1:
                row, first, many = (x[place % of == nth] for x in (row, first, many))
            for x, y in _pairs_of(row, first, many):
                other = place[x] != place[y]
                x, y = x[other], y[other]
                sim = r[x] * r[y]
                if shrink > 0:
                    sim /= 1 + (total[x] + total[y]) / shrink
                key, sim = _summed_by((place[x] // of) * n_items + place[y], sim)
                i, j = np.divmod(key, n_items)
                bucket = i // wide
                cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(key)]
                spans = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
                packed = [pa.array([m[a:b].tobytes() for a, b in spans], pa.binary()) for m in ((i * of + nth).astype(np.int32), j.astype(np.int32), sim)]
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in spans], pa.int32()), *packed], ["b", "i", "j", "sim"])

    return run


def _best_of_buckets(top_k: int, n_items: int):
    """(i, j, sim, rank): the top_k of each i, by buckets that come one after another."""

    def best(held: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        i, j, sim = (np.concatenate([np.frombuffer(x[c], t) for x in held]) for c, t in enumerate((np.int32, np.int32, np.float64)))
        key, sim = _summed_by(i.astype(np.int64) * n_items + j, sim)
        i, j = np.divmod(key[sim > 0], n_items)
        sim = sim[sim > 0]
        by = np.lexsort((j, -np.round(sim, 9), i))
        nth = np.arange(len(by)) - np.searchsorted(i, i[by])
        by, nth = by[nth < top_k], nth[nth < top_k]
        return pa.RecordBatch.from_arrays([pa.array(i[by].astype(np.int32)), pa.array(j[by].astype(np.int32)), pa.array(sim[by]), pa.array((nth + 1).astype(np.int32))], ["i", "j", "sim", "rank"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for b, *row in zip(*(batch.column(c).to_pylist() for c in ("b", "i", "j", "sim")), strict=True):
                if b != now and held:
                    yield best(held)
                    held = []
                now = b
                held.append(row)
        if held:
            yield best(held)

    return run


def neighbour_table(cells: DataFrame, top_k: int = 50, shrink: float = 10.0) -> DataFrame:
    """neighbours() of similarity(), stored, in as many slices of items as the number of pairs asks for."""
    n_pairs = cells.groupBy("user_id").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    n_items = cells.select("product_id").distinct().count()
    if n_items * n_items <= PAIRS_HELD:
        return checkpointed(neighbours(_mirrored(cells, shrink), top_k))
    places = _places(cells)
    rows = _unit_rows(cells, True).join(item_popularity(cells), "product_id").join(places, "product_id")
    rows = rows.select("user_id", F.col("place").alias("product_id"), "r", "total", "n")
    of = -(-n_pairs // PAIRS_A_SLICE) or 1
    n_buckets = max(1, min(n_pairs // of // PAIRS_A_BUCKET + 1, n_items // of))
    tiles = _history_tiles(rows, ("product_id", "r", "total"))
    tiles = checkpointed(tiles) if of > 1 else tiles
    return reduce(DataFrame.unionByName, [checkpointed(_slice(tiles, places, top_k, shrink, n_items, n_buckets, of, nth)) for nth in range(of)])


def _slice(tiles: DataFrame, places: DataFrame, top_k: int, shrink: float, n_items: int, n_buckets: int, of: int, nth: int) -> DataFrame:
    """(i, j, sim, rank) of the items of a slice."""
    packed = tiles.mapInArrow(_bucketed_sums(shrink, n_items, n_buckets, of, nth), "b int, i binary, j binary, sim binary")
    best = packed.repartition(min(n_buckets, 10_000), "b").sortWithinPartitions("b").mapInArrow(_best_of_buckets(top_k, n_items), "i int, j int, sim double, rank int")
    name = lambda c: places.select(F.col("place").alias(c), F.col("product_id").alias(f"{c}_id"))
    return best.join(name("j"), "j").join(name("i"), "i").select(F.col("i_id").alias("i"), F.col("j_id").alias("j"), "sim", "rank")


def neighbours(sims: DataFrame, top_k: int = 50) -> DataFrame:
    """Each row's top_k; the result is not symmetric."""
    order = Window.partitionBy("i").orderBy(F.desc(F.round("sim", 9)), "j")
    return sims.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def scores(cells: DataFrame, near: DataFrame) -> DataFrame:
    """(user_id, product_id, score): a user's cells times the rows of the pruned table.

    Cells travel to their user with their neighbours as lists, and as many tasks add up as the number of products asks for.
    """
    packs = packed_neighbours(near)
    n_scores = cells.join(packs.select("product_id", F.size("near").alias("n")), "product_id").agg(F.sum("n")).first()[0] or 0
    least = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = cells.join(packs, "product_id").select("user_id", "value", "near").repartition(min(max(-(-n_scores // SCORES_A_TASK), least), 10_000), "user_id")
    met = F.transform("near", lambda x: F.struct(x["j"].alias("product_id"), (F.col("value") * x["sim"]).alias("score")))
    return laid.select("user_id", F.explode(met).alias("x")).select("user_id", "x.*").groupBy("user_id", "product_id").agg(F.sum("score").alias("score"))


def packed_neighbours(near: DataFrame) -> DataFrame:
    """(product_id, near): each row of the pruned table as one list."""
    return near.groupBy(F.col("i").alias("product_id")).agg(F.collect_list(F.struct("j", "sim")).alias("near"))


def scores_and_seen(cells: DataFrame, near: DataFrame) -> DataFrame:
    """(user_id, product_id, score, seen): scores, and zeros for seen items without one.

    Laid out by user, so that what follows per user (scaling, ranking) doesn't move a row again. Cells
    travel with their neighbours as lists, which become rows only where they arrive.
    """
    return _scores_and_seen(cells, packed_neighbours(near))


def _scores_and_seen(cells: DataFrame, packs: DataFrame) -> DataFrame:
    laid = cells.join(packs, "product_id", "left").select("user_id", "product_id", "value", "near").repartition("user_id")
    entry = lambda item, score, seen: F.struct(item.alias("product_id"), score.alias("score"), F.lit(seen).alias("seen"))
    met = F.transform(F.coalesce("near", F.array().cast("array<struct<j:string,sim:double>>")), lambda x: entry(x["j"], F.col("value") * x["sim"], False))
    every = laid.select("user_id", F.explode(F.concat(F.array(entry(F.col("product_id"), F.lit(0.0), True)), met)).alias("x")).select("user_id", "x.*")
    return every.groupBy("user_id", "product_id").agg(F.sum("score").alias("score"), F.max("seen").alias("seen"))


def scaled_scores(found: DataFrame, n_items: DataFrame) -> DataFrame:
    """scores scaled to 0..1 over the whole catalogue, without its zero rows.

    All scores are positive, so a user's least is zero unless every item has one.
    n_items is one row with the column n.
    """
    met = found.crossJoin(F.broadcast(n_items))  # one row
    of_user = Window.partitionBy("user_id")
    low = F.when(F.count("*").over(of_user) < F.col("n"), 0.0).otherwise(F.min("score").over(of_user))
    high = F.max("score").over(of_user)
    scaled = F.when(high - low > 1e-12, (F.col("score") - low) / (high - low)).otherwise(0.0)
    return met.withColumn("score", scaled).select(*found.columns)


def _user_slices(cells: DataFrame, sizes: DataFrame) -> list[DataFrame]:
    """cells by users, so that a slice meets about SCORES_A_SLICE neighbours; sizes (product_id, n)."""
    n_scores = cells.join(sizes, "product_id").agg(F.sum("n")).first()[0] or 0
    of = -(-n_scores // SCORES_A_SLICE) or 1
    return [cells if of == 1 else cells.where(F.pmod(F.xxhash64("user_id"), F.lit(of)) == nth) for nth in range(of)]


def _lists(cells: DataFrame, near: DataFrame, k: int, n_items: int) -> DataFrame:
    """(user_id, product_id, score, rank): each user's best k unseen items among those that the neighbours score, scaled; stored.

    A cell travels to its user with its neighbours' places and similarities as two arrays; a task adds up and ranks whole users.
    """
    places = _places(near.select(F.col("j").alias("product_id")).distinct().unionByName(cells.select("product_id").distinct()))
    n_places = places.count()
    met = near.select("i", F.col("j").alias("product_id"), "sim").join(places, "product_id").groupBy(F.col("i").alias("product_id")).agg(F.collect_list(F.struct("place", "sim")).alias("x"))
    packs = checkpointed(places.join(met, "product_id", "left").select("product_id", "place", F.coalesce("x.place", F.array().cast("array<int>")).alias("js"), F.coalesce("x.sim", F.array().cast("array<double>")).alias("sims")))
    sizes = packs.select("product_id", F.size("js").alias("n"))
    parts = []
    for some in _user_slices(cells, sizes):
        # Dealt by a hash of the id, as ids of one slice share what a repartition by the id itself goes by.
        laid = some.select("user_id", "product_id", "value").join(packs, "product_id").select("user_id", "place", "value", "js", "sims").repartition(F.xxhash64("user_id", F.lit(7))).sortWithinPartitions("user_id")
        best = laid.mapInArrow(_best_of_users(k, n_items, n_places), "user_id string, place int, score double, rank int")
        parts.append(checkpointed(best.join(places, "place").select("user_id", "product_id", "score", "rank")))
    return reduce(DataFrame.unionByName, parts)


def _best_of_users(k: int, n_items: int, n_places: int):
    """(user_id, place, score, rank) of cells with their neighbours, which come user by user."""

    def lists(rows: pa.RecordBatch) -> pa.RecordBatch:
        names = rows.column("user_id")
        users = names.dictionary_encode()
        who = np.asarray(users.indices).astype(np.int64)
        own, value = np.asarray(rows.column("place")).astype(np.int64), np.asarray(rows.column("value"), np.float64)
        many = np.asarray(rows.column("js").value_lengths())
        seen = np.sort(who * n_places + own)
        # A seen item that nothing scores counts as zero.
        key = np.concatenate([np.repeat(who, many) * n_places + np.asarray(rows.column("js").flatten()), seen])
        key, score = _summed_by(key, np.concatenate([np.repeat(value, many) * np.asarray(rows.column("sims").flatten(), np.float64), np.zeros(len(seen))]))
        user, place = np.divmod(key, n_places)
        starts = np.searchsorted(user, np.arange(len(users.dictionary) + 1))
        high, low, n = np.maximum.reduceat(score, starts[:-1]), np.minimum.reduceat(score, starts[:-1]), np.diff(starts)
        low = np.where(n < n_items, 0.0, low)
        some = high - low > 1e-12
        scaled = (score - np.repeat(low, n)) * np.repeat(some, n) / np.repeat(np.where(some, high - low, 1.0), n)
        order = -np.round(scaled, 9)
        order[np.searchsorted(key, seen)] = np.inf
        picks, sizes = [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            mine = order[a:b]
            edge = np.partition(mine, k - 1)[k - 1] if b - a > k else np.inf
            pick = np.flatnonzero((mine <= edge) & (mine < np.inf))
            pick = pick[np.argsort(mine[pick], kind="stable")[:k]]
            picks.append(pick + a)
            sizes.append(len(pick))
        at, n = np.concatenate(picks), np.array(sizes)
        rank = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + 1
        whose = users.dictionary.take(pa.array(np.repeat(np.arange(len(n)), n)))
        return pa.RecordBatch.from_arrays([whose, pa.array(place[at].astype(np.int32)), pa.array(scaled[at]), pa.array(rank.astype(np.int32))], ["user_id", "place", "score", "rank"])

    def chunks(rows: pa.RecordBatch, last: bool) -> Iterator[tuple[pa.RecordBatch, bool]]:
        """Whole users of SCORES_HELD products or so, then what may go on in the next batch."""
        who = np.asarray(rows.column("user_id").dictionary_encode().indices)
        ends = np.concatenate([np.flatnonzero(np.diff(who)) + 1, [len(who)] if last else []]).astype(np.int64)
        total, at = np.cumsum(1 + np.asarray(rows.column("js").value_lengths())), 0
        while len(ends) and at < ends[-1]:
            fits = ends[np.searchsorted(ends, at, side="right"):]
            n = np.searchsorted(total[fits - 1], (total[at - 1] if at else 0) + SCORES_HELD, side="right")
            end = int(fits[max(0, n - 1)])
            yield rows.slice(at, end - at), True
            at = end
        if at < rows.num_rows:
            yield rows.slice(at), False

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0] if held else batch
            held = []
            for part, whole in chunks(rows, False):
                if whole:
                    yield lists(part)
                else:
                    held = [part]
        for rows in held:
            for part, _ in chunks(rows, True):
                yield lists(part)

    return run


def recommend(cells: DataFrame, products: DataFrame, near: DataFrame, k: int, candidates: DataFrame | None = None) -> DataFrame:
    """Each user's best k unseen items by scaled score; unscored items follow by id.

    candidates (product_id) restrict what can be listed, not how scores are scaled. Only users
    with less than k unseen items of a score above zero meet unscored ones.
    """
    n_items = products.select("product_id").distinct().agg(F.count("*").alias("n"))
    if candidates is None:
        top = _lists(cells, near, k, n_items.first()[0])
    else:
        products = products.join(candidates.select("product_id").distinct(), "product_id", "left_semi")
        allowed = F.broadcast(products.select("product_id")) if candidates.count() <= BROADCAST_ITEMS else products.select("product_id")
        packs = checkpointed(packed_neighbours(near))
        slices = _user_slices(cells, packs.select("product_id", F.size("near").alias("n")))
        top = reduce(DataFrame.unionByName, [checkpointed(rank_topk(scaled_scores(_scores_and_seen(some, packs), n_items).join(allowed, "product_id", "left_semi").where("not seen"), k)) for some in slices])
    # Scores that round to zero rank with the items that have none, by id.
    positive = top.where(F.round("score", 9) > 0)
    full = positive.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = checkpointed(cells.select("user_id").distinct().join(full.select("user_id"), "user_id", "left_anti"))
    if short.isEmpty():
        return top
    seen = seen_items(cells.join(short, "user_id", "left_semi"))
    few = checkpointed(positive.join(short, "user_id", "left_semi").select("user_id", "product_id", "score"))
    padding = rank_topk(padded(few, short, products, seen, k), k, exclude=seen)
    return top.join(short, "user_id", "left_anti").unionByName(padding)


def similar(near: DataFrame, products: DataFrame, product_id: str, k: int = 10, exclude_self: bool = True) -> DataFrame:
    """Ranks by the item's column of the pruned table; items without an entry score zero.

    KeyError if the catalogue lacks the item.
    """
    if not products.where(F.col("product_id") == product_id).take(1):
        raise KeyError(product_id)
    column = near.where(F.col("j") == product_id).select(F.lit(product_id).alias("user_id"), F.col("i").alias("product_id"), F.col("sim").alias("score"))
    own = products.sparkSession.createDataFrame([(product_id, product_id)], "user_id string, product_id string")
    mask = own if exclude_self else own.limit(0)
    return rank_topk(padded(column, own, products, mask, k), k, exclude=mask)


__all__ = ["cooccurrence", "minmax_per_user", "neighbour_table", "neighbours", "recommend", "scaled_scores", "scores", "similar", "similarity"]
