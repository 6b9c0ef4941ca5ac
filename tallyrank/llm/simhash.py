"""Near-duplicate groups by SimHash, compared exactly tile against tile.

Every distinct fingerprint goes into a tile, named by the population counts of its four
16-bit quarters. Two fingerprints at Hamming distance d differ by at most d in the sum of
those four counts' differences, so tile pairs beyond the radius are skipped unread; all
others are compared whole with numpy's exclusive-or and bit counts. A tile pair gives
links enough to connect what it connects, never all its pairs. Copies share a
fingerprint and are compared once.

Cost: with n distinct fingerprints about n * n / 17 comparisons of a nanosecond or two
remain, which is the price of an exact all-pairs answer by tiles. Dense groups stop early:
as soon as a tile pair is one component the rest of it is skipped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, fresh, slices, stored, utf8
from .components import connected_components

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
TILE_ROWS = 4096
QUARTERS = 4
_BLOCK = 128


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats counted; no words: 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths), ends[min(shingle, len(words)) - 1 :]
    ones, count = np.zeros(64, np.int64), len(ends)
    for at in range(0, count, 1 << 16):
        some = ends[at : at + (1 << 16)]
        cut = map(joined.__getitem__, map(slice, starts[at : at + len(some)].tolist(), some.tolist()))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, len(some))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """docs with fp, the 64 bits of its text as a signed long, in place of text; docs has doc_id, text and at most mark (long)."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            found = np.array([fingerprint(x, shingle) for x in utf8(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(found.view(np.int64))], [*rest, "fp"])

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in (*rest, "fp")))


def tile_links(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Index pairs that connect all that values of a and b within the radius connect.

    The two arrays may be the same object. Indices are into a followed by b.
    """
    same = a is b
    first = 0 if same else len(a)
    label = np.arange(len(a) if same else len(a) + len(b))
    left, links = len(label), []
    for at in range(0, len(a), _BLOCK):
        close = np.bitwise_count(a[at : at + _BLOCK, None] ^ b[None, :]) <= radius
        if same:
            np.fill_diagonal(close[:, at:], False)
        for i in np.flatnonzero(close.any(axis=1)).tolist():
            met = np.flatnonzero(close[i]) + first
            groups, where = np.unique(label[met], return_index=True)
            mine = label[at + i]
            fresh = groups != mine
            if fresh.any():
                links += [(at + i, j) for j in met[where[fresh]].tolist()]
                label[np.isin(label, groups)] = mine
                left -= int(fresh.sum())
                if left == 1:
                    return links
    return links


def _compare(radius: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            cols = [batch.column(c) for c in ("a", "b")]
            values = [np.asarray(c.values).view(np.uint64) for c in cols]
            bounds = [np.asarray(c.offsets).tolist() for c in cols]
            itself = batch.column("itself").to_pylist()
            for i in range(batch.num_rows):
                a, b = (x[o[i] : o[i + 1]] for x, o in zip(values, bounds, strict=True))
                if itself[i]:
                    b = a
                    both = a
                elif found_none(a, b, radius):
                    continue
                else:
                    both = np.concatenate([a, b])
                for x, y in tile_links(a, b, radius):
                    u.append(both[x])
                    v.append(both[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v)], ["u", "v"])

    def found_none(a: np.ndarray, b: np.ndarray, radius: int) -> bool:
        return len(a) * len(b) <= 1 << 16 and not (np.bitwise_count(a[:, None] ^ b[None, :]) <= radius).any()

    return run


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of the four counts that the radius allows, one of each opposite pair."""
    near = (d for d in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, d)) <= radius)
    return [d for d in near if d >= (0,) * QUARTERS]


def links(values: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (u, v) that connect all distinct values of column fp within the radius.

    At most 17 ** 4 = 83,521 tile names exist, which bounds the table of them.
    """
    counts = [F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(0xFFFF)) for q in range(QUARTERS)]
    named = values.select("fp", *(c.alias(f"q{i}") for i, c in enumerate(counts)))
    names = [f"q{i}" for i in range(QUARTERS)]
    sizes = named.groupBy(*names).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("parts"))
    tiles = stored(
        named.join(F.broadcast(sizes), names)
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .groupBy(*names, "part")
        .agg(F.collect_list("fp").alias("fps")),
        "tiles",
    )
    step = F.explode(F.array(*(F.array(*map(F.lit, d)) for d in _steps(radius)))).alias("d")
    near = tiles.select(*(F.col(c).alias(f"a{c}") for c in [*names, "part"]), step).select(
        *(f"a{c}" for c in [*names, "part"]), *((F.col(f"aq{i}") + F.col("d")[i]).alias(f"q{i}") for i in range(QUARTERS))
    )
    near = near.where(" and ".join(f"{c} between 0 and 16" for c in names))
    pairs = near.join(tiles.select(*names, "part"), names)
    alike = " and ".join(f"a{c} = {c}" for c in names)
    pairs = pairs.withColumn("itself", F.expr(f"{alike} and apart = part")).where(F.expr(f"not ({alike}) or apart <= part"))
    mine = tiles.select(*(F.col(c).alias(f"a{c}") for c in [*names, "part"]), F.col("fps").alias("a"))
    full = pairs.join(mine, [f"a{c}" for c in [*names, "part"]]).join(tiles.withColumnRenamed("fps", "b"), [*names, "part"])
    return full.select("a", "b", "itself").mapInArrow(_compare(radius), "u long, v long")


def _groups(prints: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """(fp, root) of every distinct fingerprint; root names its group."""
    values = stored(prints.select("fp").distinct(), "values")
    roots = stored(connected_components(links(values, radius, tile_rows)), "roots")
    return values.join(roots, values.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id of each row's near-duplicate group.

    Null and empty texts have fingerprint zero and are grouped like any other. A null
    doc_id joins its fingerprint's group but never names one; a group of nulls alone has
    a null name. Repeated rows are each returned. An empty table gives no rows.
    """
    prints = stored(fingerprints(documents_of(docs), shingle), "fingerprints")
    groups = stored(_groups(prints, radius, tile_rows), "groups")
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(groups, "fp")
    named = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    names = stored(groups.join(named, "root").select("fp", "component_id"), "names")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE_WORDS, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest doc_id; all columns stay.

    Rows without doc_id come after all others. Of rows with one doc_id the smallest by a
    hash of their columns (but maps) stays, and of wholly equal rows any one.
    """
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    mark = F.xxhash64(*hashed)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), mark.alias("mark"))
    prints = stored(fingerprints(own, shingle), "fingerprints")
    groups = stored(_groups(prints, radius, tile_rows), "groups")
    # Equal rows are counted and a group's first is a minimum, both added up before they move: a group may be any size.
    rows = stored(prints.groupBy("fp", "doc_id", "mark").agg(F.count("*").alias("n")).join(groups, "fp").select("root", "doc_id", "mark", "n"), "members")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    first = rows.groupBy("root").agg(F.min(order).alias("first")).select(F.col("root").alias("r"), "first.*")
    met = rows.join(first.select("r", F.col("doc_id").alias("f_id"), F.col("mark").alias("f_mark")), F.col("root") == F.col("r"))
    is_first = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("mark") == F.col("f_mark"))
    i, m = fresh(docs, "__id", "__mark")
    acted = stored(met.select(F.col("doc_id").alias(i), F.col("mark").alias(m), is_first.alias("is_first"), F.col("n").alias("copies")).where("not is_first or copies > 1"), "acted-on")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(i)) & (mark == F.col(m))
    left = docs.join(acted.select(i, m), same, "left_anti")
    repeated = acted.where("is_first").select(i, m)
    if repeated.isEmpty():
        return left
    once = docs.join(repeated, same).dropDuplicates([i, m]).select(*docs.columns)
    return left.unionByName(once)
