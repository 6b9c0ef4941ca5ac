import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrank.llm import toxicity as tx

BAD = ["idiot", "scum", "moron", "lowein", "loweist"]


def corpus(n, seed=0, share=0.3):
    r = random.Random(seed)
    common = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 7))) for _ in range(150)]
    out = []
    for _ in range(n):
        w = [r.choice(common) for _ in range(r.randrange(5, 150))]
        y = int(r.random() < share)
        if y:
            for _ in range(1 + len(w) // 30):
                w[r.randrange(len(w))] = r.choice(BAD)
        out.append((" ".join(w).capitalize() + ".", y))
    return out


def test_gradients():
    net = tx.Network({b"ab": 1, b"cd": 2}, seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = [b"ab", b"cd", b"other", b"\xc3\xa9"]
    x = net.inputs(words).astype(np.float64)
    r = np.random.default_rng(0)
    index = r.integers(0, 4, (3, tx.WINDOW))
    mask = np.arange(tx.WINDOW) < np.array([[tx.WINDOW], [5], [1]])
    y = np.array([1.0, 0.0, 1.0])

    def loss(v):
        s = tx._sigmoid(net.forward(v, index, mask))
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).sum()

    out, kept = net.forward(x, index, mask, keep=True)
    assert np.allclose(out, net.forward(x, index, mask))
    g, dx = net.backward(x, kept, tx._sigmoid(out) - y)
    for k in ("Wf", "Ub", "bf", "Wb", "Uf", "q", "w", "c"):
        for at in [tuple(r.integers(0, s) for s in net.p[k].shape) for _ in range(4)]:
            old = net.p[k][at]
            net.p[k][at] = old + 1e-3
            up = loss(x)
            net.p[k][at] = old - 1e-3
            down = loss(x)
            net.p[k][at] = old
            assert abs((up - down) / 2e-3 - g[k][at]) < 2e-3 + 0.02 * abs(g[k][at]), k
    for at in [(0, 0), (1, 3), (2, 9), (3, 20)]:
        a, b = x.copy(), x.copy()
        a[at] += 1e-3
        b[at] -= 1e-3
        assert abs((loss(a) - loss(b)) / 2e-3 - dx[at]) < 2e-3 + 0.02 * abs(dx[at])


def test_inputs_of_a_word_do_not_depend_on_its_neighbours():
    net = tx.Network({b"abc": 1})
    words = [b"abc", b"d", b"\xc3\xa9tre", b"longer1"]
    assert np.allclose(net.inputs(words), np.vstack([net.inputs([w]) for w in words]), atol=1e-6)


@pytest.mark.parametrize("n", [0, 1, 23, 24, 25, 36, 37, 500])
def test_windows_cover_and_overlap(n):
    first = tx.windows_of(n)
    covered = {i for f in first for i in range(f, min(n, f + tx.WINDOW))}
    assert covered == set(range(n)) and all(b - a <= tx.STRIDE for a, b in zip(first, first[1:]))


def test_scores_do_not_depend_on_the_batch():
    net = tx.Network({b"idiot": 1}, 5)
    texts = [t.encode() for t, _ in corpus(30)] + [b"", None, b"...", b"word " * 3000]
    alone = np.concatenate([net.scores([t]) for t in texts])
    assert np.allclose(net.scores(texts), alone, atol=1e-5) and ((alone >= 0) & (alone <= 1)).all()


def test_learns_and_filters(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(corpus(600))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "scum " * 10), (7000, None), (7001, ""), (3, rows[3][1])], "doc_id long, text string").withColumn("toxic", F.lit("clash")).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, text int")
    net = tx.trained(docs, labels)
    got = tx.score_texts(docs, net).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    truth = dict((i, y) for i, _, y in rows)
    test = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in test]) > 0.93
    left = tx.drop_toxic(docs, net)
    assert left.columns == docs.columns and left.count() == sum(r.predicted == 0 for r in got)
    assert tx.score_texts(docs.limit(0), net).count() == 0


def test_sample_is_bounded_and_leaves_out_held_out_rows(spark):
    rows = [(i, f"text {i}", i % 2) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    sample = tx.training_sample(docs, labels, rows=20)
    assert sum(y for _, y in sample) == 20 and len(sample) == 20 * (1 + tx.CLEAN_TIMES)
    assert all(zlib.crc32(t.split()[1].encode()) % 3 != 1 for t, _ in sample)


def test_one_class_or_none():
    assert tx.train([], []).scores([b"a b"])[0] < 0.01
    assert tx.train([b"a", b"b"], [1, 1]).scores([b"a b", None])[1] > 0.9


def slow_score(net, text):
    """The network word by word and gate by gate, without any of its own functions."""
    words = "".join(chr(b).lower() if b < 128 and chr(b).isalnum() else chr(b) if b > 127 else " " for b in text).split()
    words = [w.encode("latin-1") for w in words]
    if not words:
        return 1 / (1 + np.exp(-float(net.p["c"][0])))

    def vector(w):
        marked = b" " + w + b" "
        grams = [(marked[i] * 65599 + marked[i + 1] * 257 + marked[i + 2]) % tx.CHAR_BUCKETS for i in range(len(w))]
        begins, code = [], 0
        for i, b in enumerate(w[:10].ljust(10, b"\0")):
            code = (code * 257 + b + 1) % 2147483647
            if i + 1 == 4 or 4 < i + 1 <= min(len(w), 10):
                begins.append(code % tx.BEGIN_BUCKETS)
        return np.concatenate([net.p["word"][net.vocabulary.get(w, 0)], np.mean([net.p["char"][g] for g in grams], axis=0), np.mean([net.p["begin"][b] for b in begins], axis=0)]).astype(float)

    def direction(xs, k):
        h, out, n = np.zeros(tx.HIDDEN), [], tx.HIDDEN
        for x in xs:
            a, u = x @ net.p[f"W{k}"] + net.p[f"b{k}"], h @ net.p[f"U{k}"]
            z, r = (1 / (1 + np.exp(-(a[i : i + n] + u[i : i + n]))) for i in (0, n))
            h = (1 - z) * np.tanh(a[2 * n :] + r * u[2 * n :]) + z * h
            out.append(h)
        return out

    best = -np.inf
    starts = sorted({*range(0, max(1, len(words) - 24), 12), max(0, len(words) - 24)})
    for at in starts:
        xs = [vector(w) for w in words[at : at + 24]]
        s = np.hstack([direction(xs, "f"), direction(xs[::-1], "b")[::-1]])
        e = np.exp(s @ net.p["q"])
        best = max(best, float((e / e.sum()) @ s @ net.p["w"] + net.p["c"][0]))
    return 1 / (1 + np.exp(-best))


def test_scores_match_a_plain_forward_pass():
    rows = corpus(120)
    net = tx.train([t.encode() for t, _ in rows], [y for _, y in rows], settings=tx.Settings(rounds=1, steps=10))
    texts = [t.encode() for t, _ in rows[:25]] + [b"", b"...", b"one", "été ÉTÉ x".encode(), b"IDIOT, idiot " * 40]
    assert np.allclose(net.scores(texts), [slow_score(net, t) for t in texts], atol=1e-5)


def test_trials_see_no_held_out_row_and_each_fold_once(spark):
    from tallyrank.llm.toxicity_trials import cross_validate, summary

    rows = [(i, t, y) for i, (t, y) in enumerate(corpus(240))]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    sample = tx.training_sample(docs, labels)
    held = {t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert not held & {t for t, _ in sample}
    short = tx.Settings(rounds=2, steps=20)
    found = cross_validate(spark, sample, {"a": short, "b": tx.Settings(rounds=1, steps=5)}, folds=2, seeds=(0,))
    assert sorted((r.trial, r.seed, r.fold) for r in found.collect()) == [(t, 0, f) for t in "ab" for f in (0, 1)]
    assert {r.trial: r.n for r in summary(found).collect()} == {"a": 2, "b": 2}


def test_what_is_gathered_is_bounded(spark):
    docs = spark.createDataFrame([(0, "a " * 30_000), (7, "short"), (7, "other"), (7, "short"), (9, None), (2, "held out")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (7, 1), (9, 0), (2, 1)], "doc_id long, toxic int")
    sample = tx.training_sample(docs, labels)
    assert len(sample) == 2 and sample[0] == ("", 0) and sample[1] in (("short", 1), ("other", 1))


def test_ensemble_is_the_mean_of_its_networks(spark):
    texts = [f"good words number {i} stand here" for i in range(12)] + [f"vile slur number {i} stands here" for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 12)) for i in range(24)], "doc_id long, toxic int")
    both = tx.trained(docs, labels, seeds=(3, 4))
    sample = tx.training_sample(docs, labels)
    alone = [tx.train([t.encode() for t, _ in sample], [y for _, y in sample], seed) for seed in (3, 4)]
    want = np.mean([n.text_logits([t.encode() for t in texts])[0] for n in alone], axis=0)
    assert np.allclose(both.text_logits([t.encode() for t in texts]), want, atol=1e-4)
    assert both.scores([None, b""]).shape == (2,)


def test_networks_are_trained_one_after_another(spark):
    """Two trainings at once on one executor took it over its memory."""
    rows = corpus(20)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    spark.sparkContext.setJobGroup("training", "")
    try:
        assert len(tx.trained(docs, labels, seeds=(0, 1)).networks) == 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    last = status.getJobInfo(max(status.getJobIdsForGroup("training")))
    assert [status.getStageInfo(s).numTasks for s in last.stageIds] == [1]
