import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrank.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def slow(text):
    text = text or ""
    words = re.findall(WORD, text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(WORD, x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


TEXTS = ["", None, "a b", "a b c a b c", "a a a a", "x\ny\nx\n\n \n \nx ", "é É z\x1cq \x0b\x0c\r\t|", "<#*$%&|>", "a b c d a b c x a b c", "the end\n" * 40]


@pytest.mark.parametrize("text", TEXTS)
def test_counts(text):
    assert quality.text_counts(text)[:5] == slow(text)


def prose(r, n):
    return " ".join(r.choice(["Some", "plain", "words", "that", "people", "write", "down,", "often."]) + "abcdefgh"[r.integers(8)] * r.integers(3) for _ in range(n))


def test_judge(spark):
    r = np.random.default_rng(5)
    rows = [(i, prose(r, int(r.integers(60, 400))), "en", "a" if i % 3 else "b") for i in range(450)]
    bad = {1000 + i: "### " + " $$$ ".join(prose(r, 100).split()) for i in range(40)} | {2000 + i: prose(r, 100).upper() for i in range(40)}
    rows += [(d, t, "en", "a") for d, t in bad.items()]
    rows += [(3000, None, "en", "a"), (3001, "", None, None), (3002, "few words", "en", "a"), (3003, prose(r, 80), None, None), (None, prose(r, 80), "en", "a"), (3004, "same words here " * 40, "en", "a"), (5, rows[5][1], "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("kept", F.lit("clash")).withColumn("pool", F.lit(1)).withColumn("n", F.lit(1))
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    for d, t, _, _ in rows:
        n, chars, symbols, dup, rep = slow(t)
        x = by[d]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert x.base_failed == (n < 50 or 100 * rep > 50 * n) and not (x.base_failed and x.kept)
    assert not any(by[d].kept for d in bad)
    assert all(by[d].kept for d in range(450)) and by[3003].kept and by[None].kept
    assert all((x.distance is None) == x.base_failed for x in got)


def test_mcd_resists_and_agrees_with_its_steps():
    r = np.random.default_rng(1)
    x = np.vstack([r.normal(0, 1, (300, 6)) @ np.diag([1, 2, 1, 1, 3, 1]), r.normal(40, 0.1, (90, 6))])
    floor = np.full(6, 1e-6)
    mean, cov = quality.fast_mcd(x, floor=floor)
    assert np.abs(mean).max() < 1 and np.sqrt(np.diag(cov)).max() < 4
    again = quality.concentrate(x, mean, cov, int(np.ceil(0.75 * len(x))), floor)
    assert np.linalg.slogdet(again[1])[1] >= np.linalg.slogdet(cov)[1] - 1e-6
    assert np.allclose(quality.fast_mcd(x[::-1], floor=floor)[0], mean)


def test_one_step_matches_numpy(spark):
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (400, 6))
    rows = spark.createDataFrame([("p", *map(float, v)) for v in x], "pool string, " + ", ".join(f"{c} double" for c in quality.FEATURES))
    start = spark.createDataFrame(quality._row("p", np.zeros(6), np.eye(6)), quality._ESTIMATE)
    got = quality._step(rows, start).first()
    d2 = (x**2).sum(axis=1)
    bins = np.floor(np.log2(d2) * quality.BINS_PER_OCTAVE)
    cut = np.sort(bins)[int(np.ceil(0.75 * 400)) - 1]
    assert np.allclose(got["mean"], x[bins <= cut].mean(axis=0))


def test_small_groups_are_judged_by_their_language_or_by_all(spark):
    r = np.random.default_rng(6)
    rows = [(i, prose(r, int(r.integers(60, 200))), "en", "large") for i in range(300)]
    small = [(1000, prose(r, 100), "en", "tiny"), (1001, prose(r, 100).upper(), "en", "tiny"), (1002, prose(r, 100), "xx", None), (1003, " $ ".join(prose(r, 100).split()), "xx", None), (1004, prose(r, 90), None, "s")]
    docs = spark.createDataFrame(rows + small, "doc_id long, text string, lang string, source string")
    kept = {x.doc_id: x.kept for x in quality.judge(docs).collect()}
    assert {d: kept[d] for d, *_ in small} == {1000: True, 1001: False, 1002: True, 1003: False, 1004: True} and all(kept[i] for i in range(300))
    few = spark.createDataFrame(rows[:8] + [(9, " ".join(["###"] * 4 + prose(r, 100).upper().split()), "en", "large")], "doc_id long, text string, lang string, source string")
    assert {x.doc_id: x.kept for x in quality.judge(few).collect()} == {i: i != 9 for i in [*range(8), 9]}


def test_copies_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(quality, "CHUNK_ROWS", 10)
    names = list(quality.FEATURES)
    rows = spark.range(95).select(F.lit("p").alias("pool"), F.lit(None).cast("long").alias("doc_id"), *(F.lit(1.0).alias(c) for c in names)).unionByName(spark.range(25).select(F.lit("p").alias("pool"), F.col("id").alias("doc_id"), *(F.rand(3).alias(c) for c in names)))
    got = quality._dealt(rows).groupBy("chunk").agg(F.sum("w").alias("n"), F.max("w").alias("most")).collect()
    assert sum(x.n for x in got) == 120 and len(got) == 12 and max(x.most for x in got) == 8


def test_steps_settle(spark):
    r = np.random.default_rng(4)
    x = np.vstack([r.normal(0, 1, (900, 6)), r.normal(9, 1, (100, 6))])
    rows = spark.createDataFrame([("p", i, *map(float, v)) for i, v in enumerate(x)], "pool string, doc_id long, " + ", ".join(f"{c} double" for c in quality.FEATURES))
    far = spark.createDataFrame(quality._row("p", np.full(6, 3.0), np.eye(6) * 20), quality._ESTIMATE)
    now = quality._settled(rows, far, quality._FLOOR, 0.75).first()
    again = quality._step(rows, spark.createDataFrame([now], quality._ESTIMATE)).first()
    assert now.det - again.det <= quality.SETTLED and np.abs(now["mean"]).max() < 0.3


def test_chi2():
    assert abs(quality.chi2_quantile(0.5, 6) - 5.348) < 0.02 and abs(quality.chi2_quantile(0.99, 6) - 16.812) < 0.1


def test_empty(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
