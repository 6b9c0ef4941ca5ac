import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyrank.llm import simhash
from tallyrank.llm.components import connected_components


def slow_print(text):
    words = [w for w in (text or "").encode().lower().replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows, radius=4):
    prints = [slow_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((d for (d, _), h in zip(rows, group) if h == g and d is not None), default=None) for g in group}
    return sorted(((d, p, least[g]) for (d, _), p, g in zip(rows, prints, group)), key=str)


def texts(seed=1):
    r = random.Random(seed)
    base = [" ".join(r.choice(["Ab", "cd", "ÉF", "gh", "ij", "kl", "x9"]) + str(r.randrange(40)) for _ in range(r.choice([1, 3, 5, 60, 400]))) for _ in range(25)]
    out = []
    for t in base:
        out += [t, t]
        w = t.split()
        for k in (0, len(w) // 2):
            out.append(" ".join(w[:k] + ["zz"] + w[k + 1 :]))
    return out + [None, "", " \n\t", "one", "ONE", "a b c"]


@pytest.mark.parametrize("tile_rows", [4096, 2])
def test_groups_match_brute_force(spark, tile_rows):
    rows = list(enumerate(texts())) + [(None, "one"), (3, texts()[3]), (None, "alone and without id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(7))
    got = simhash.near_duplicates(docs, tile_rows=tile_rows).collect()
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == slow_groups(rows)


def test_matches_sparks_own_hash(spark):
    words = "x y z w".encode()
    assert spark.sql("select xxhash64('x y z w') h").first().h % 2**64 == xxhash.xxh64_intdigest(words, 42) == simhash.fingerprint(words)


def test_long_text_is_cut_in_chunks():
    text = " ".join(map(str, range(70_000))).encode()
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(map(str, range(i, i + 4))), 42) for i in range(70_000 - 3)], np.uint64)
    bits = [int(2 * ((hashes >> np.uint64(b)) & np.uint64(1)).sum() > len(hashes)) for b in range(64)]
    assert simhash.fingerprint(text) == sum(x << b for b, x in enumerate(bits))


@pytest.mark.parametrize("n", [1, 200, 700])
def test_tiles_keep_what_is_connected(n):
    r = np.random.default_rng(n)
    centre = r.integers(0, 2**63, 5, dtype=np.uint64)
    values = np.unique(np.array([c ^ np.uint64(sum(1 << int(b) for b in r.integers(0, 64, 2))) for c in r.choice(centre, n)], np.uint64))
    close = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4

    def parts(pairs):
        label = list(range(len(values)))
        for i, j in pairs:
            label = [label[i] if x == label[j] else x for x in label]
        return [label.index(x) for x in label]

    whole = parts(zip(*np.nonzero(close)))
    assert parts(simhash.tile_links(values, values)) == whole
    cut = len(values) // 2
    a, b = values[:cut], values[cut:]
    within = simhash.tile_links(a, a) + [(i + cut, j + cut) for i, j in simhash.tile_links(b, b)]
    assert parts(within + simhash.tile_links(a, b)) == whole


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, k) for k in range(101, 140)] + [(50, 50), (60, 61), (61, 60)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {got[k] for k in range(31)} == {0} and {got[k] for k in range(100, 140)} == {100} and got[61] == 60
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one_and_empty(spark):
    docs = spark.createDataFrame([(5, "a b c d e", "x"), (2, "a b c d e", "y"), (9, "quite other words here now", None), (None, "a b c d e", "z"), (9, "quite other words here now", None), (None, "alone", "p"), (None, "alone", "q")], "doc_id long, text string, extra string").withColumn("__id", F.lit(1)).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    left = simhash.keep_one(docs)
    assert left.columns == ["doc_id", "text", "extra", "__id", "m"]
    got = sorted((r.doc_id or 0, r.text, r.extra) for r in left.collect())
    assert got[1:] == [(2, "a b c d e", "y"), (9, "quite other words here now", None)] and got[0][:2] == (0, "alone") and got[0][2] in ("p", "q")
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_keep_one_against_brute_force(spark):
    rows = list(enumerate(texts(3))) + [(None, "one"), (3, texts(3)[3]), (3, "another text of the same id"), (None, texts(3)[8]), (None, texts(3)[8]), (400, texts(3)[8] + " ")]
    groups = {}
    prints = [slow_print(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and label[i] != label[j]:
                label = [label[j] if g == label[i] else g for g in label]
    for (d, t), g in zip(rows, label):
        groups.setdefault(g, []).append((d is None, d or 0))
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(min(g) for g in groups.values())
