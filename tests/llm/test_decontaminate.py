import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyrank.llm import decontaminate


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(13, len(v))
        if item is None or not n:
            continue
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
        at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in wins]
        if at:
            found.add(str(item))
        hit |= {i + k for i in at for k in range(n)}
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def fixture(seed):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdeé" for b in "xyz9"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([13, 14, 30, 60, 13, 12, 5, 3, 20])] + [(20, "one"), (21, "two Words"), (22, None), (23, ""), (24, "..."), (None, text(20)), (9, "ax " * 30), (3, "dup of an id with other text in it, of more words than thirteen are"), (2, text(30))]
    items.append(items[2])
    docs = [(0, None), (1, ""), (2, "..."), (3, "zz one zz"), (4, "TWO, words!"), (5, "ax " * 40), (6, "ax " * 12), (7, "dup of an id with other text in it, of more words than thirteen are")]
    for k in range(60):
        v = words(r.choice([t for _, t in items if t]))
        a = r.randrange(max(1, len(v) - 8))
        cut = v[a : a + r.randrange(10, 40)]
        if r.random() < 0.3 and len(cut) > 5:
            cut[r.randrange(len(cut))] = "other"
        docs.append((10 + k, f"{text(r.randrange(50))} {', '.join(cut)} {text(r.randrange(600))} {' '.join(cut[:14])}"))
    return docs + [(None, items[3][1]), (15, docs[15][1]), (15, "same id, other text " + items[3][1])], items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limit", [10**6, 60, 0])
def test_against_brute_force(spark, seed, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    rows, items = fixture(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("n_words", F.lit(3))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted((tuple(r) for r in decontaminate.contamination(docs, bench).collect()), key=str)
    assert got == sorted(((d, *slow(t, items)) for d, t in rows), key=str)
    assert sum(r[-1] for r in got) > 20


def test_empty_tables_and_clean(spark):
    rows, items = fixture(1)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    none = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.contaminated or r.n_hit for r in none)
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    left = decontaminate.clean_rows(docs.withColumn("more", F.lit("x")), bench)
    assert left.columns == ["doc_id", "text", "more"] and sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted((x for x in rows if not slow(x[1], items)[-1]), key=str)


def test_hits_meet_proposed_places_only(spark):
    """No join of all surviving shingles with all of the benchmark's: each joins with what proposals lay out."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 9}" for j in range(60))) for i in range(20)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w0 w1 w2 w3 w4 w5"), (2, " ".join(f"w{j % 9}" for j in range(40)))], "item_id long, text string")
    assert sorted(tuple(r) for r in decontaminate.contamination(docs, bench).collect()) == sorted((d, *slow(t, [(r.item_id, r.text) for r in bench.collect()])) for d, t in docs.collect())


def test_stage_judges_rows_without_or_with_repeated_ids(spark, monkeypatch):
    import corpus_pipeline

    rows, items = fixture(1)
    dirty = next(t for i, t in items if i == 3)
    rows += [(None, "a clean row without an id"), (77, dirty), (77, "a clean row of a repeated id"), (None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: bench)
    left = corpus_pipeline.decontamination_stage(spark, spark.createDataFrame(rows, "doc_id long, text string").withColumn("more", F.lit("x")), "")
    assert left.columns == ["doc_id", "text", "more"]
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert sorted(got, key=str) == sorted((x for x in rows if not slow(x[1], items)[-1]), key=str)
    assert (None, dirty) not in got and (77, dirty) not in got and (77, "a clean row of a repeated id") in got


def test_no_occurrence_rests_on_hashes(spark, monkeypatch):
    # A hash that tells words apart by their first letter alone: everything collides, the words decide.
    def weak(words, k):
        n = F.size(words)
        at = lambda i: F.substring(F.get(words, i), 1, 1)
        return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(at(i + j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))

    monkeypatch.setattr(decontaminate, "shingles", weak)
    rows, items = fixture(3)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.contamination(docs, bench).collect()), key=str)
    assert got == sorted(((d, *slow(t, items)) for d, t in rows), key=str)
