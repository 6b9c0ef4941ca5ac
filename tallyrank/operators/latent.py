"""Truncated singular vectors of the user by item table, by passes over it until residuals are small.

While the items' factor block (items times factors) is within a bound, the driver holds it and a Krylov basis
made of it; each pass ships a block to the tasks, which multiply their users' rows with it and back and
add up whole blocks of items. Beyond the bound the same basis is a table of blocks of items, the cells are packed tiles of
a block of users by one of items, and only matrices of the basis' width meet on the driver. The scores of a user are its row times V times V transposed, made for
a chunk of users against all items by one matrix product; of the dense result only what is
asked for leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, discard
from .sparse import block_count, block_of

FACTORS = 64
OVERSAMPLE = 10
#: Residuals in units of the largest eigenvalue of X'X, and passes after which it's an error not to have reached it.
TOLERANCE = 1e-7
MAX_PASSES = 200
#: Blocks of a Krylov basis before it starts anew from its best vectors.
KRYLOV_BLOCKS = 8
#: The same of a basis in blocks of items, of which every pass writes a new copy.
SPREAD_BLOCKS = 3
FACTOR_SCHEMA = "product_id string, factors array<double>"
#: Numbers of a factor block that is sent to tasks: half a gigabyte of doubles.
MAX_BLOCK = 1 << 26
#: Numbers of a block that the driver iterates with (its basis is KRYLOV_BLOCKS of these), and of a block of items of a basis beyond that.
DRIVER_NUMBERS = 1 << 20
STATE_NUMBERS = 1 << 23
#: So many items or fewer are solved exactly, by one pass with a block as wide as they are many.
EXACT_ITEMS = 512
#: Items of a block of partial sums, and numbers of a chunk of dense scores.
BLOCK_ITEMS = 4096
CHUNK_NUMBERS = 1 << 22
BLOCK_USERS = 512


def _checked(n_items: int, width: int) -> None:
    if n_items * width > MAX_BLOCK:
        raise ValueError(f"{n_items} items with {width} factors exceed the block of {MAX_BLOCK} numbers")


def item_factors(cells: DataFrame, products: DataFrame | None = None, n_factors: int = FACTORS, tolerance: float = TOLERANCE, seed: int = 42) -> DataFrame:
    """(product_id, factors) of the items that have cells: right singular vectors, the largest first.

    Passes go on until every factor's residual, |X'X v - lambda v|, is within the tolerance of the largest
    lambda; RuntimeError if MAX_PASSES don't suffice. Up to DRIVER_NUMBERS numbers the items' block is
    held by the driver, beyond that by the tasks.
    """
    n_users = cells.select("user_id").distinct().count()
    items = cells.select("product_id").distinct()
    n_own = items.count()
    n_items = products.select("product_id").distinct().count() if products is not None else n_own
    f = min(n_factors, max(2, min(n_users, n_items) - 1), max(1, n_own))
    spark = cells.sparkSession
    if not n_own:
        return spark.createDataFrame([], FACTOR_SCHEMA)
    width = n_own if n_own <= EXACT_ITEMS else min(f + OVERSAMPLE, n_own)
    if n_own * width > min(MAX_BLOCK, DRIVER_NUMBERS):
        return _spread_factors(cells, f, min(f + OVERSAMPLE, n_own), n_own, n_users, tolerance, seed)
    ids = [r.product_id for r in items.orderBy("product_id").collect()]
    block = _driver_block(cells, ids, f, width, tolerance, seed)
    return spark.createDataFrame(pd.DataFrame({"product_id": ids, "factors": block.tolist()}), FACTOR_SCHEMA)


def _driver_block(cells: DataFrame, ids: list[str], f: int, width: int, tolerance: float, seed: int) -> np.ndarray:
    """The factors as a block (items, f): a Krylov basis that each pass widens by the block of residuals, restarted from its best when it is full."""
    spark, n = cells.sparkSession, len(ids)
    places = spark.createDataFrame(list(zip(ids, range(n), strict=True)), "product_id string, i int")
    rows = checkpointed(cells.join(places, "product_id").groupBy("user_id").agg(F.collect_list("i").alias("i"), F.collect_list("value").alias("v")).select("i", "v"))

    def gram(block: np.ndarray) -> np.ndarray:
        """X'X times block."""
        shipped = spark.sparkContext.broadcast(block)

        def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shipped.value
            out = np.zeros_like(q)
            for part in parts:
                lists, values = part.column("i"), part.column("v")
                at, flat_i, flat_v = np.asarray(lists.offsets), np.asarray(lists.values), np.asarray(values.values)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    i, v = flat_i[a:b], flat_v[a:b]
                    out[i] += np.outer(v, v @ q[i])  # a user's items are distinct
            for b in range(0, len(q), BLOCK_ITEMS):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([out[b : b + BLOCK_ITEMS].tobytes()], pa.binary())], ["b", "y"])

        def add(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"b": part["b"].iloc[:1], "y": [sum(np.frombuffer(y) for y in part["y"]).tobytes()]})

        found = rows.mapInArrow(run, "b int, y binary").groupBy("b").applyInPandas(add, "b int, y binary").collect()
        shipped.unpersist()
        return np.concatenate([np.frombuffer(r.y) for r in sorted(found, key=lambda r: r.b)]).reshape(block.shape)

    most = max(width, min(n, MAX_BLOCK // n // 2, KRYLOV_BLOCKS * width))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0]
    images = gram(basis)
    for _ in range(MAX_PASSES):
        small = basis.T @ images
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(-values)[:width]
        ritz, met = basis @ vectors[:, best], images @ vectors[:, best]
        rest = met - ritz * values[best]
        if basis.shape[1] == n or np.linalg.norm(rest[:, :f], axis=0).max() <= tolerance * max(values[best[0]], 1e-300):
            return ritz[:, :f]
        if basis.shape[1] + width > most:
            basis, images = ritz, met
        for _ in range(2):
            rest -= basis @ (basis.T @ rest)
            rest = np.linalg.qr(rest)[0]
        rest = rest[:, : n - basis.shape[1]]
        basis, images = np.hstack([basis, rest]), np.hstack([images, gram(rest)])
    raise RuntimeError(f"factors did not settle within {tolerance} in {MAX_PASSES} passes")


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _bytes(m: np.ndarray) -> bytes:
    """A matrix with its shape before it."""
    return np.array(m.shape, np.int64).tobytes() + np.ascontiguousarray(m, np.float64).tobytes()


def _of_bytes(cell: pa.Scalar) -> np.ndarray:
    buffer = cell.as_buffer()
    return np.frombuffer(buffer, np.float64, offset=16).reshape(np.frombuffer(buffer, np.int64, 2))


def _rows_of(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each block's key and matrices."""
    for batch in batches:
        for r in range(batch.num_rows):
            yield batch.column(key)[r].as_py(), [_of_bytes(batch.column(c)[r]) for c in batch.schema.names if c != key]


def _summed(blocks: DataFrame, shape: tuple[int, int], part) -> np.ndarray:
    """The sum over blocks of the small matrix that part makes of a block's matrices; its size doesn't depend on the items."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, matrices in _rows_of(batches, "ib"):
            total = part(*matrices).ravel() + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "x"])

    out = np.zeros(shape[0] * shape[1])
    for at, x in blocks.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x")).collect():
        out[at] = x
    return out.reshape(shape)


def _mapped(blocks: DataFrame, names: tuple[str, ...], make) -> DataFrame:
    """(ib, names): the matrices that make gives for those of each block, stored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ib, matrices in _rows_of(batches, "ib"):
            yield pa.RecordBatch.from_arrays([pa.array([ib], pa.int32()), *(pa.array([_bytes(m)], pa.binary()) for m in make(ib, *matrices))], ["ib", *names])

    return checkpointed(blocks.mapInArrow(run, ", ".join(["ib int", *(f"{n} binary" for n in names)])))


def user_projections(cells: DataFrame, factors: DataFrame, width: int) -> DataFrame:
    """(user_id, u): each user's row times the factors, as sums of columns."""
    met = cells.join(factors, "product_id").groupBy("user_id").agg(*(F.sum(F.col("value") * F.get("factors", F.lit(c))).alias(f"u{c}") for c in range(width)))
    return met.select("user_id", F.array(*(f"u{c}" for c in range(width))).alias("u"))


def _places(cells: DataFrame, key: str, name: str, n: int) -> DataFrame:
    """(key, block, place): each key's block of n, and its place in it by order of key."""
    held = cells.select(key).distinct().withColumn(f"{name}b", block_of(key, n))
    return checkpointed(held.withColumn(name, F.row_number().over(Window.partitionBy(f"{name}b").orderBy(key)) - 1))


def _cell_tiles(cells: DataFrame, items: DataFrame, users: DataFrame, n: int) -> DataFrame:
    """(ub, ib, u, i, v): the cells of a block of users and one of items as places and values, packed; n tiles at most."""
    laid = cells.join(items, "product_id").join(users, "user_id").select("ub", "ib", "u", "i", F.col("value").cast("double").alias("v"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def packed() -> pa.RecordBatch:
            columns = [np.concatenate([np.asarray(x.column(c)) for x in held]).astype(t) for c, t in (("u", np.int32), ("i", np.int32), ("v", np.float64))]
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in now), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], ["ub", "ib", "u", "i", "v"])

        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in ("ub", "ib")])
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    key = tuple(keys[:, a].tolist())
                    if key != now and held:
                        yield packed()
                        held.clear()
                    now = key
                    held.append(batch.slice(a, b - a))
        if held:
            yield packed()

    return checkpointed(laid.repartition(min(n, 10_000), "ub", "ib").sortWithinPartitions("ub", "ib").mapInArrow(run, "ub int, ib int, u binary, i binary, v binary"))


def _times(tiles: DataFrame, blocks: DataFrame, own: str, other: str) -> DataFrame:
    """(other's block, y): the tiles' table, or its transpose, times the matrix whose blocks (own's block, y) are given. Partial sums of a block are added up one by one."""
    keys = {"i": "ib", "u": "ub"}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q = _of_bytes(batch.column("y")[r])
                a, b, v = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in ((own, np.int32), (other, np.int32), ("v", np.float64)))
                out = np.stack([np.bincount(b, v * q[a, c]) for c in range(q.shape[1])], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(keys[other]).slice(r, 1), pa.array([_bytes(out)], pa.binary())], [keys[other], "y"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_bytes(total)], pa.binary())], [keys[other], "y"])
        for key, (y,) in _rows_of(batches, keys[other]):
            if key != now:
                if now is not None:
                    yield row()
                now, total = key, y.copy()
            elif len(y) > len(total):  # places behind the last one met are zero
                y = y.copy()
                y[: len(total)] += total
                total = y
            else:
                total[: len(y)] += y
        if now is not None:
            yield row()

    schema = f"{keys[other]} int, y binary"
    made = tiles.join(blocks, keys[own]).mapInArrow(run, schema)
    return checkpointed(made.repartition(keys[other]).sortWithinPartitions(keys[other]).mapInArrow(add, schema))


def _spread_factors(cells: DataFrame, f: int, width: int, n_items: int, n_users: int, tolerance: float, seed: int) -> DataFrame:
    """_driver_block() with the basis laid out by blocks of items: tiles of cells meet its blocks, small matrices alone meet on the driver.

    A pass removes what it has stored as soon as the next table is written.
    """
    most = max(width, min(n_items, SPREAD_BLOCKS * width))
    n_ib, n_ub = (-(-n // max(BLOCK_ITEMS, STATE_NUMBERS // most)) for n in (n_items, n_users))
    items, users = _places(cells, "product_id", "i", n_ib), _places(cells, "user_id", "u", n_ub)
    tiles = _cell_tiles(cells, items, users, n_ib * n_ub)

    def gram(blocks: DataFrame) -> DataFrame:
        of_users = _times(tiles, blocks, "i", "u")
        out = _times(tiles, of_users, "u", "i")
        discard(of_users)
        return out

    def pair(m: np.ndarray, other: np.ndarray) -> np.ndarray:
        return m.T @ other

    def orthonormal(blocks: DataFrame, k: int, w: int) -> tuple[DataFrame, int]:
        """(ib, y): y of (ib, basis, y) without its part in the k columns of basis, as orthonormal columns; those that depend on others are left out."""
        made = None
        for last in (False, True):
            inside = _summed(blocks, (k, w), pair)
            clean = _mapped(blocks, ("basis", "y"), lambda _, basis, y: (basis, y - basis @ inside))  # noqa: B023
            if made is not None:
                discard(made)
            own = _summed(clean, (w, w), lambda _, y: y.T @ y)
            scale = np.sqrt(np.maximum(np.diag(own), 1e-300))
            values, vectors = np.linalg.eigh(own / np.outer(scale, scale))
            good = values > 1e-12
            by = vectors[:, good] / np.sqrt(values[good]) / scale[:, None]
            names = ("y",) if last else ("basis", "y")
            made = _mapped(clean, names, lambda _, basis, y: (basis, y @ by)[-len(names) :])  # noqa: B023
            discard(clean)
            blocks, w = made, int(good.sum())
        return made, w

    sizes = items.groupBy("ib").agg(F.count("*").alias("n"))

    def start(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ib, n in zip(*(batch.column(c).to_pylist() for c in ("ib", "n")), strict=True):
                made = (np.zeros((n, 0)), np.random.default_rng([seed, ib]).normal(size=(n, width)))
                yield pa.RecordBatch.from_arrays([pa.array([ib], pa.int32()), *(pa.array([_bytes(m)], pa.binary()) for m in made)], ["ib", "basis", "y"])

    begun = checkpointed(sizes.mapInArrow(start, "ib int, basis binary, y binary"))
    new, k = orthonormal(begun, 0, width)
    images = gram(new)
    state = checkpointed(new.withColumnRenamed("y", "basis").join(images.withColumnRenamed("y", "images"), "ib"))
    discard(begun, new, images)
    for _ in range(MAX_PASSES):
        small = _summed(state, (k, k), pair)
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(-values)[:width]
        values, vectors = values[best], vectors[:, best]
        rest = lambda basis, images: images @ vectors - basis @ vectors * values  # noqa: B023, E731
        lengths = np.sqrt(_summed(state, (1, len(best)), lambda basis, images: (rest(basis, images) ** 2).sum(axis=0)))  # noqa: B023
        if k == n_items or lengths[0, :f].max() <= tolerance * max(values[0], 1e-300):
            found = _mapped(state, ("y",), lambda _, basis, images: (basis @ vectors[:, :f],))  # noqa: B023
            out = _unpacked(found, items)
            discard(found, state, tiles, items, users)
            return out
        full = k + width > most
        own = (lambda basis: basis @ vectors) if full else (lambda basis: basis)  # noqa: B023, E731
        kept = _mapped(state, ("basis", "images", "y"), lambda _, basis, images: (own(basis), own(images), rest(basis, images)[:, : n_items - basis.shape[1]]))  # noqa: B023
        discard(state)
        k, w = len(best) if full else k, min(len(best), n_items - k)
        new, w = orthonormal(kept.select("ib", "basis", "y"), k, w)
        images = gram(new)
        met = kept.select("ib", "basis", "images").join(new, "ib").join(images.withColumnRenamed("y", "z"), "ib")
        state, k = _mapped(met, ("basis", "images"), lambda _, basis, images, y, z: (np.hstack([basis, y]), np.hstack([images, z]))), k + w
        discard(kept, new, images)
    raise RuntimeError(f"factors did not settle within {tolerance} in {MAX_PASSES} passes")


def _unpacked(blocks: DataFrame, items: DataFrame) -> DataFrame:
    """(product_id, factors) of the blocks' rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ib, (y,) in _rows_of(batches, "ib"):
            for a in range(0, len(y), BLOCK_ITEMS):
                part = y[a : a + BLOCK_ITEMS]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * y.shape[1], pa.int32()), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), ib), pa.int32()), pa.array(np.arange(a, a + len(part)), pa.int32()), lists], ["ib", "i", "factors"])

    return checkpointed(items.join(blocks.mapInArrow(run, "ib int, i int, factors array<double>"), ["ib", "i"]).select("product_id", "factors"))


def factor_block(factors: DataFrame) -> tuple[list[str], np.ndarray]:
    """The items with factors in order of id, and their factors: bounded by MAX_BLOCK numbers."""
    width = factors.agg(F.max(F.size("factors"))).first()[0] or 0
    _checked(factors.count(), width)
    found = factors.select("product_id", "factors").orderBy("product_id").collect()
    return [r.product_id for r in found], np.array([r.factors for r in found], float).reshape(len(found), width)


def user_rows(cells: DataFrame, ids: list[str]) -> DataFrame:
    """(user_id, i, v): each user's cells with items as places in ids; a user without such items has empty lists."""
    places = cells.sparkSession.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), "product_id string, i int")
    return cells.join(places, "product_id", "left").groupBy("user_id").agg(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "value"))).alias("c")).select("user_id", F.col("c.i").alias("i"), F.col("c.value").alias("v"))


def projections(batch: pa.RecordBatch, block: np.ndarray, first: int, last: int) -> np.ndarray:
    """Rows first to last of the users' cells (i, v) times the block."""
    lists, values = batch.column("i"), batch.column("v")
    at, flat_i, flat_v = np.asarray(lists.offsets), np.asarray(lists.values), np.asarray(values.values)
    out = np.zeros((last - first, block.shape[1]))
    for n, (a, b) in enumerate(zip(at[first:last].tolist(), at[first + 1 : last + 1].tolist(), strict=True)):
        out[n] = flat_v[a:b] @ block[flat_i[a:b]]
    return out


def scores(cells: DataFrame, factors: DataFrame) -> DataFrame:
    """(user_id, product_id, score) of each user with cells and each item with factors: dense."""
    width = factors.agg(F.max(F.size("factors"))).first()[0] or 0
    if factors.count() * width > MAX_BLOCK:
        return _spread_scores(cells, factors, width)
    ids, block = factor_block(factors)
    shipped = cells.sparkSession.sparkContext.broadcast((ids, block))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, v = shipped.value
        step = max(1, CHUNK_NUMBERS // max(1, len(names)))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                b = min(a + step, batch.num_rows)
                dense = projections(batch, v, a, b) @ v.T
                who = batch.column("user_id").slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), len(names))))
                yield pa.RecordBatch.from_arrays([who, pa.array(names * (b - a), pa.string()), pa.array(dense.ravel())], ["user_id", "product_id", "score"])

    return user_rows(cells, ids).mapInArrow(run, "user_id string, product_id string, score double")


def _spread_scores(cells: DataFrame, factors: DataFrame, width: int) -> DataFrame:
    """scores() for factors that no one machine holds: blocks of users meet blocks of items."""
    users = cells.select("user_id").distinct().join(user_projections(cells, factors, width), "user_id", "left").select("user_id", F.coalesce("u", F.array_repeat(F.lit(0.0), width)).alias("u"))
    n_ub, n_ib = block_count(users, BLOCK_USERS), block_count(factors, BLOCK_ITEMS)
    people = users.groupBy(block_of("user_id", n_ub).alias("ub")).agg(F.collect_list(F.struct("user_id", "u")).alias("users"))
    items = factors.groupBy(block_of("product_id", n_ib).alias("ib")).agg(F.collect_list(F.struct("product_id", "factors")).alias("items"))
    pairs = people.withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(n_ib - 1)))).join(items, "ib")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = batch.column("users")[r].values, batch.column("items")[r].values
                dense = _matrix(a.field("u")) @ _matrix(b.field("factors")).T
                i, j = (pa.array(x.ravel()) for x in np.indices(dense.shape))
                yield pa.RecordBatch.from_arrays([a.field("user_id").take(i), b.field("product_id").take(j), pa.array(dense.ravel())], ["user_id", "product_id", "score"])

    return pairs.repartition(min(n_ub * n_ib, 10_000), "ub", "ib").select("users", "items").mapInArrow(run, "user_id string, product_id string, score double")


def explain(cells: DataFrame, factors: DataFrame, near: DataFrame) -> DataFrame:
    """One row: explained_variance (see explained), n_factors, and knn_nnz, the entries of the neighbour table."""
    width = factors.agg(F.coalesce(F.max(F.size("factors")), F.lit(0)).alias("n_factors"))
    return width.crossJoin(F.broadcast(near.agg(F.count("*").alias("knn_nnz")))).select(F.lit(float(explained(cells, factors))).alias("explained_variance"), "n_factors", "knn_nnz")  # one row each


def explained(cells: DataFrame, factors: DataFrame) -> float:
    """The share of the table's squared values that the factors keep."""
    whole = cells.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0
    long = factors.select("product_id", F.posexplode("factors").alias("c", "v"))
    kept = cells.join(long, "product_id").groupBy("user_id", "c").agg(F.sum(F.col("value") * F.col("v")).alias("u")).agg(F.sum(F.col("u") * F.col("u"))).first()[0] or 0.0
    return kept / whole if whole else 0.0
