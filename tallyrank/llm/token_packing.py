"""Token ids packed into fixed-length training rows.

Each task packs pools of a bounded number of tokens: texts longer than a row are cut into
whole rows and a rest, the rests go longest first into the row where they leave least
space, found by a segment tree over capacities. Nothing is dropped and nothing shuffles;
a lost task packs the same pools again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import documents_of, slices

ROW_TOKENS = 2048
POOL_TOKENS = 1 << 22
END = 50256


class CapacityTree:
    """Open rows by free space; best(n) takes a row whose space is the least at or above n."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: dict[int, list[int]] = {}

    def add(self, space: int, row: int) -> None:
        self.rows.setdefault(space, []).append(row)
        at = space + self.base
        while at:
            self.count[at] += 1
            at >>= 1

    def best(self, size: int) -> tuple[int, int] | None:
        """(row, its space), taken out; None if no open row has room. Among equals the row opened last."""
        at, count = size + self.base, self.count
        while not count[at]:
            while at & 1:  # up from right children; past the root there is nothing larger
                at >>= 1
                if not at:
                    return None
            at += 1
        while at < self.base:
            at = 2 * at + (not count[2 * at])
        space = at - self.base
        row = self.rows[space].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return row, space


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indices: best fit in order of falling length (ties: input order); each length is at most capacity."""
    tree, rows = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        row, space = tree.best(lengths[i]) or (len(rows), capacity)
        if row == len(rows):
            rows.append([])
        rows[row].append(i)
        if space > lengths[i]:
            tree.add(space - lengths[i], row)
    return rows


_FIELDS = pa.schema([("shard", pa.string()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64()))])
SCHEMA = "shard string, row int, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<long>"


def pack_documents(docs: DataFrame, encoder: Encoder, row_tokens: int = ROW_TOKENS, pool_tokens: int = POOL_TOKENS, end: int = END) -> DataFrame:
    """One row per row of a packed id matrix.

    ids holds row_tokens little-endian ids (2 bytes each where all ids fit, else 4), filled
    up with the end id. Segment i lies from cu_seqlens[i] to cu_seqlens[i + 1] and is the
    part of document doc_ids[i] from its token doc_offsets[i]; positions start at 0 again at
    each of position_resets. Every row of docs ends in the end id, so a null or empty text
    is that id alone; repeated rows and null ids are packed like others. Rows come in no order.
    """
    kind = np.dtype("<u2" if max(end + 1, encoder.n_ids) <= 1 << 16 else "<u4")

    def packed(pool: list[tuple[int | None, np.ndarray]], shard: str) -> Iterator[pa.RecordBatch]:
        parts = [(d, at, ids[at : at + row_tokens]) for d, ids in pool for at in range(0, len(ids), row_tokens)]
        rows = pack([len(ids) for _, _, ids in parts], row_tokens)
        for start in range(0, len(rows), 512):
            out = []
            for number, row in enumerate(rows[start : start + 512], start):
                held = np.full(row_tokens, end, kind)
                bounds = [0]
                for i in row:
                    held[bounds[-1] : bounds[-1] + len(parts[i][2])] = parts[i][2]
                    bounds.append(bounds[-1] + len(parts[i][2]))
                out.append((shard, number, bounds[-1], held.tobytes(), bounds, bounds[:-1], [parts[i][0] for i in row], [parts[i][1] for i in row]))
            yield pa.RecordBatch.from_pydict(dict(zip(_FIELDS.names, zip(*out, strict=True), strict=True)), _FIELDS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder.get().encode_ordinary, TaskContext.get().partitionId()
        pool, held, number = [], 0, 0
        for batch in slices(batches, 500):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end], kind)
                pool.append((doc_id, ids))
                held += len(ids)
                if held >= pool_tokens:
                    yield from packed(pool, f"{task:06d}-{number:04d}")
                    pool, held, number = [], 0, number + 1
        if pool:
            yield from packed(pool, f"{task:06d}-{number:04d}")

    return documents_of(docs).mapInArrow(run, SCHEMA)


def position_ids(cu_seqlens: list[int], row_tokens: int = ROW_TOKENS) -> np.ndarray:
    """Each token's place in its segment; 0 in the filling."""
    out = np.zeros(row_tokens, np.int32)
    for a, b in zip(cu_seqlens, cu_seqlens[1:], strict=False):
        out[a:b] = np.arange(b - a)
    return out


def unpack(packs: DataFrame, wide: bool = False) -> DataFrame:
    """(doc_id, ids) of the packed documents, end ids included; doc_ids must be unique."""
    code = np.dtype("<u4" if wide else "<u2")

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            flat = [(d, at, np.frombuffer(r["ids"], code)[a:b].tolist()) for r in rows for d, at, a, b in zip(r["doc_ids"], r["doc_offsets"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False)]
            kinds = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("ids", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_pydict(dict(zip(kinds.names, zip(*flat, strict=True), strict=True)) if flat else {c: [] for c in kinds.names}, kinds)

    parts = packs.select("ids", "cu_seqlens", "doc_ids", "doc_offsets").mapInArrow(run, "doc_id long, at long, ids array<int>")
    return parts.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x.ids)).alias("ids"))


def write_packs(docs: DataFrame, encoder: Encoder, path: str, **options) -> None:
    pack_documents(docs, encoder, **options).write.parquet(path)
