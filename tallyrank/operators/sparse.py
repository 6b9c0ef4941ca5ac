"""Blocks of sparse rows and their products, in numpy.

A row is two lists, names and values. Rows travel in blocks of bounded size, and a block
meets a block inside a task: names that many rows of the right-hand block have are columns of a dense
product, all others are met through an index from names to the rows that have them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block, columns of a product made at once, products of the index made at once.
BLOCK_ROWS = 1024
PRODUCT_COLUMNS = 2048
INDEX_STEP = 1 << 22
#: A name is dense if one of so many rows has it.
DENSE_SHARE = 8


def packed(features: DataFrame) -> DataFrame:
    """(product_id, fs, vs): one row for each item of (product_id, feature, value)."""
    rows = features.groupBy("product_id").agg(F.collect_list(F.struct("feature", "value")).alias("x"))
    return rows.select("product_id", F.col("x.feature").alias("fs"), F.col("x.value").alias("vs"))


def block_count(df: DataFrame, rows: int | None = None) -> int:
    return -(-df.count() // (rows or BLOCK_ROWS)) or 1


def block_of(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


class Rows:
    """Coded rows: codes and values side by side, ends of each row."""

    def __init__(self, codes: np.ndarray, values: np.ndarray, sizes: np.ndarray):
        self.codes, self.values, self.sizes = codes, values, sizes
        self.row = np.repeat(np.arange(len(sizes)), sizes)

    def __len__(self) -> int:
        return len(self.sizes)

    def take(self, rows: np.ndarray) -> Rows:
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        at = np.concatenate([np.arange(ends[r], ends[r + 1]) for r in rows.tolist()] or [np.zeros(0, np.int64)])
        return Rows(self.codes[at], self.values[at], self.sizes[rows])

    def part(self, first: int, end: int) -> Rows:
        a, b = np.searchsorted(self.row, [first, end])
        return Rows(self.codes[a:b], self.values[a:b], self.sizes[first:end])


def coded(lists: Sequence[tuple[pa.ListArray, pa.ListArray]]) -> tuple[list[Rows], int]:
    """(names, values) of each block as Rows over one common numbering, and how many names there are."""
    flat = [names.flatten() for names, _ in lists]
    every = pa.concat_arrays(flat).dictionary_encode()
    codes, out, at = np.asarray(every.indices), [], 0
    for (names, values), own in zip(lists, flat, strict=True):
        sizes = np.asarray(names.value_lengths().fill_null(0)).astype(np.int64)
        out.append(Rows(codes[at : at + len(own)].astype(np.int64), np.asarray(values.flatten(), np.float64), sizes))
        at += len(own)
    return out, len(every.dictionary)


def products(a: Rows, b: Rows, n: int) -> np.ndarray:
    """The inner product of every row of a with every row of b; n names in all."""
    held = np.bincount(b.codes, minlength=n)
    dense = held * DENSE_SHARE >= max(len(b), 1)
    slot = np.cumsum(dense) - 1
    out = _table(a, dense, slot) @ _table(b, dense, slot).T
    thin = ~dense[a.codes] & (held[a.codes] > 0)
    if thin.any():
        order = np.argsort(b.codes, kind="stable")
        first = np.concatenate([[0], np.cumsum(held)])
        code, row, value = a.codes[thin], a.row[thin], a.values[thin]
        reach = np.cumsum(held[code])
        flat, at = out.reshape(-1), 0
        while at < len(code):
            end = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + INDEX_STEP)))
            many = held[code[at:end]]
            met = order[np.repeat(first[code[at:end]] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())]
            np.add.at(flat, np.repeat(row[at:end], many) * len(b) + b.row[met], np.repeat(value[at:end], many) * b.values[met])
            at = end
    return out


def _table(rows: Rows, dense: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """The dense columns of rows."""
    out = np.zeros((len(rows), int(dense.sum())))
    on = dense[rows.codes]
    np.add.at(out, (rows.row[on], slot[rows.codes[on]]), rows.values[on])
    return out


def cosines(left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, j, cos) of every packed row of left with every one of right that it shares a feature with.

    Blocks meet blocks, so a common feature costs no rows; what leaves a task is the result.
    """
    n_left, n_right = block_count(left), block_count(right)

    def blocks(df: DataFrame, name: str, n: int) -> DataFrame:
        return df.groupBy(block_of("product_id", n).alias(f"{name}_block")).agg(F.collect_list(F.struct("product_id", "fs", "vs")).alias(name))

    pairs = blocks(left, "a", n_left).withColumn("b_block", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1)))).join(blocks(right, "b", n_right), "b_block")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = (batch.column(c)[r].values for c in ("a", "b"))
                (left_rows, right_rows), n = coded([(x.field("fs"), x.field("vs")) for x in (a, b)])
                dot = products(left_rows, right_rows, n)
                i, j = np.nonzero(dot)
                yield pa.RecordBatch.from_arrays([a.field("product_id").take(pa.array(i)), b.field("product_id").take(pa.array(j)), pa.array(dot[i, j])], ["i", "j", "cos"])

    return pairs.repartition(min(n_left * n_right, 10_000), "a_block", "b_block").mapInArrow(run, "i string, j string, cos double")
