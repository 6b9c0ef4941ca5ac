import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrank.llm import token_packing as tp
from tallyrank.llm.bpe import Encoder


def slow_pack(lengths, capacity):
    rows, free = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fit = [r for r in range(len(rows)) if free[r] >= lengths[i]]
        if fit:
            r = min(fit, key=lambda r: free[r])
            rows[r].append(i)
            free[r] -= lengths[i]
        else:
            rows.append([i])
            free.append(capacity - lengths[i])
    return rows, free


@pytest.mark.parametrize("capacity", [1, 7, 8, 64, 100])
def test_best_fit_decreasing(capacity):
    r = random.Random(capacity)
    lengths = [r.randint(1, capacity) for _ in range(300)]
    got = tp.pack(lengths, capacity)
    assert sorted(i for row in got for i in row) == list(range(300))
    used = sorted(sum(lengths[i] for i in row) for row in got)
    assert max(used) <= capacity and used == sorted(capacity - f for f in slow_pack(lengths, capacity)[1])
    assert tp.pack([], capacity) == []


def test_round_trip_and_layout(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["alpha", "béta", "x1", "<|endoftext|>", "\n\n"]) for _ in range(n)) for n in (0, 1, 5, 40, 300, 1200, 7, 7)] + [None, "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(3)
    enc = Encoder(spark)
    packs = tp.pack_documents(docs, enc, row_tokens=64, pool_tokens=1000).cache()
    want = {d: [*enc.get().encode_ordinary(t or ""), tp.END] for d, t in enumerate(texts)}
    assert {x.doc_id: x.ids for x in tp.unpack(packs).collect()} == want
    for x in packs.collect():
        ids = np.frombuffer(x.ids, "<u2")
        assert len(ids) == 64 and x.cu_seqlens[-1] == x.n_tokens <= 64 and (ids[x.n_tokens :] == tp.END).all()
        pos = tp.position_ids(x.cu_seqlens, 64)
        assert [i for i in range(x.n_tokens) if pos[i] == 0] == x.position_resets == x.cu_seqlens[:-1]
    assert packs.select("shard", "row").distinct().count() == packs.count()
    assert packs.agg(F.sum("n_tokens")).first()[0] == sum(map(len, want.values()))


def test_nulls_and_repeats(spark):
    enc = Encoder(spark)
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string").coalesce(1)
    rows = tp.pack_documents(docs, enc, row_tokens=16).collect()
    assert len(rows) == 1 and sorted(rows[0].doc_ids, key=str) == [1, None, None] and rows[0].n_tokens == 7
    assert tp.pack_documents(docs.limit(0), enc).count() == 0
