import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import pyarrow as pa

from tallyrank.llm import importance
from tallyrank.llm.importance import Dictionary, resample, sample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["Foo bar foo BAR_x é Éa 12-3", "", None, "one", "a b a b a b c", "a b", "\x00~{  ", "x" * 5000 + " y"]


def grams(text, n_gram, n_buckets):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % n_buckets for n in range(1, n_gram + 1) for i in range(len(words) - n + 1)]


def slow(docs, target, n_gram=1, n_buckets=10_000, min_words=20, percent=10):
    s, t = Counter(), Counter()
    for rows, counts in ((docs, s), (target, t)):
        for _, text in rows:
            counts.update(grams(text, n_gram, n_buckets)[1])
    big_s, big_t = sum(s.values()) + n_buckets, sum(t.values()) + n_buckets
    out = []
    for doc_id, text in docs:
        words, found = grams(text, n_gram, n_buckets)
        gains = [math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in found]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for n, x in enumerate(able):
        x.append(n + 1 if n < percent * len(able) // 100 else None)
    return Counter(tuple(x) if len(x) == 6 else (*x, None) for x in out)


def test_words_and_tuples_by_integers():
    for n_gram in (1, 2, 3, 8):
        words = Dictionary(n_gram, 50)
        for _ in range(2):
            n_words, text, bucket, count = words.read([None if t is None else t.encode() for t in TEXTS])
            want = Counter((i, b) for i, t in enumerate(TEXTS) for b in grams(t, n_gram, 50)[1])
            assert n_words.tolist() == [len(grams(t, 1, 50)[0]) for t in TEXTS]
            assert dict(want) == {(i, b): n for i, b, n in zip(text.tolist(), bucket.tolist(), count.tolist(), strict=True)}
    assert Dictionary().read([])[0].tolist() == []


def test_a_dictionary_starts_anew_when_it_is_full(monkeypatch):
    monkeypatch.setattr(importance, "KEPT_WORDS", 2)
    words = Dictionary(2, 50)
    for t in TEXTS:
        _, _, bucket, count = words.read([None if t is None else t.encode()])
        assert dict(zip(bucket.tolist(), count.tolist(), strict=True)) == Counter(grams(t, 2, 50)[1])
    assert len(words.ids) < 10


def test_against_brute_force(spark):
    docs = [(i, " ".join(f"w{(i * j) % (7 + i % 40)}" for j in range(i % 60))) for i in range(300)] + [(None, "w1 " * 25), (3, None), (3, ""), (1000, "W1 w2 " * 30), (1000, "W1 w2 " * 30)]
    target = [(1, "w1 w2 w3 w1"), (2, None), (3, "w5 zz")]
    clash = spark.createDataFrame([(*x, 1, "a") for x in docs], "doc_id long, text string, score int, buckets string")
    goal = spark.createDataFrame(target, "item_id long, text string")
    for settings in ({}, {"n_gram": 3, "n_buckets": 97, "percent": 33}):
        got = Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in resample(clash, goal, **settings).collect())
        want = slow(docs, target, **settings)
        # Which of two equal rows is drawn is left open; their ranks are not.
        assert got == want


def test_empty_tables_and_drawn_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(i, "a b c " * (i + 1)) for i in range(40)], "doc_id long, text string")
    assert resample(none, docs).count() == 0
    ranked = resample(docs, none)
    assert Counter(map(tuple, ranked.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect())) == slow([(r.doc_id, r.text) for r in docs.collect()], [])
    assert sample(docs, ranked).count() == ranked.where("rank is not null").count() == 3


def test_words_are_numbered_in_small_slices(monkeypatch):
    """4,000 texts, up to 16 MB, were taken at once."""
    batch = pa.RecordBatch.from_pydict({"text": ["ab " * 3000] * 3000})
    cut = list(importance.slices([batch], importance.SLICE_ROWS, importance.SLICE_BYTES))
    assert sum(x.num_rows for x in cut) == 3000 and max(x.nbytes for x in cut) <= 1 << 22 and max(x.num_rows for x in cut) <= 1000
