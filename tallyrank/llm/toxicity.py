"""Toxicity scores from a bidirectional gated recurrent network, written in numpy.

A word enters as an embedding of itself (if the training rows hold it) beside the mean
embeddings of its hashed character trigrams and of its beginnings. Overlapping windows of words run through a gated
recurrent layer in both directions, attention pools each window's states, and a linear
layer gives its logit. All windows of a text are scored; the text's score is that of its
highest window. Training is multiple-instance: in every round each row's windows are
scored, and its highest one (for clean rows its highest two and a random one) carries the row's label.

The result is the mean of the networks of two seeds.

Training takes a sample of labelled rows of at most TRAIN_ROWS toxic and CLEAN_TIMES as many clean ones, chosen by a
hash of their ids, of texts up to TRAIN_CHARS; scoring covers every text whole. One scan, no shuffle.
How the settings were chosen, without the held-out rows, is in toxicity_trials.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ProcessPoolExecutor
from dataclasses import dataclass
from multiprocessing import get_context

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_of, slices, utf8

WINDOW = 24
STRIDE = 12
HIDDEN = 8
WORD_SIZE = 8
CHAR_SIZE = 8
CHAR_BUCKETS = 4096
#: A word's first so many bytes, hashed.
BEGINNINGS = range(4, 11)
BEGIN_BUCKETS = 1 << 15
#: Bounds of what training takes: toxic rows, times as many clean ones, and words that have an embedding of their own.
TRAIN_ROWS = 700
CLEAN_TIMES = 3
MAX_WORDS = 20_000
#: Longer texts aren't trained on, so what the driver gathers is at most TRAIN_ROWS * (1 + CLEAN_TIMES) * TRAIN_CHARS characters.
TRAIN_CHARS = 40_000
BATCH = 128
THRESHOLD = 0.7
#: The networks that are averaged. Scoring costs as many times one network's.
SEEDS = (0, 1)


@dataclass(frozen=True)
class Settings:
    """What cross-validation chooses between.

    A word needs min_rows training rows for an embedding of its own; it is hidden in training
    with the probability hide; embeddings shrink back to their start by shrink a step.
    """

    rounds: int = 6
    steps: int = 60
    rate: float = 0.02
    min_rows: int = 4
    hide: float = 0.15
    shrink: float = 0.02
    stride: int = STRIDE


DEFAULT = Settings()

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of all words, with a blank on both sides, and where each word's begin."""
    data = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = (data[:-2] * 65599 + data[1:-1] * 257 + data[2:]) % CHAR_BUCKETS
    starts = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]])
    # The two places between words hold trigrams of neither; a word has as many as characters.
    keep = np.ones(len(data), bool)
    keep[(starts + lengths)[:-1, None] + np.arange(2)] = False
    return codes[keep[: len(codes)]], np.concatenate([[0], np.cumsum(lengths)[:-1]])


def beginnings(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed beginnings of all words, the shortest word's whole self among them, and how many each word has."""
    longest = BEGINNINGS[-1]
    data = np.frombuffer(b"".join([w[:longest].ljust(longest, b"\0") for w in words]), np.uint8).reshape(-1, longest).astype(np.int64)
    lengths = np.fromiter((min(len(w), longest) for w in words), np.int64, len(words))
    code, out, valid = np.zeros(len(words), np.int64), [], []
    for i in range(longest):
        code = (code * 257 + data[:, i] + 1) % 2147483647
        if i + 1 in BEGINNINGS:
            out.append(code)
            valid.append((lengths > i) | (i + 1 == BEGINNINGS[0]))
    valid = np.stack(valid, axis=1)
    return (np.stack(out, axis=1) % BEGIN_BUCKETS)[valid], valid.sum(axis=1)


def windows_of(n: int, stride: int = STRIDE) -> np.ndarray:
    """The first word of each window of n words; the last window ends with the text."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    return np.append(np.arange(0, n - WINDOW, stride), n - WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def hashes_of(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """What the inputs of words look up, whatever the network: trigrams with their starts and sizes, beginnings and how many."""
    codes, starts = trigrams(words)
    return codes, starts, np.fromiter(map(len, words), np.float32, len(words))[:, None], *beginnings(words)


class Laid:
    """Texts as numbers of their distinct words, cut into windows: what networks of one stride share."""

    def __init__(self, texts: list[bytes | None], stride: int = STRIDE):
        seen: dict[bytes, int] = defaultdict()
        seen.default_factory = seen.__len__
        ids = [np.fromiter(map(seen.__getitem__, words_of(t)), np.int64) for t in texts]
        self.words = list(seen)
        self.hashed = hashes_of(self.words) if self.words else None
        self.flat = np.concatenate([*ids, np.zeros(0, np.int64)])
        lengths = np.array([len(i) for i in ids], np.int64)
        firsts = [windows_of(n, stride) for n in lengths.tolist()]
        self.counts = np.array([len(f) for f in firsts], np.int64)
        self.begin = np.concatenate([*(f + b for f, b in zip(firsts, np.cumsum([0, *lengths])[:-1], strict=True)), np.zeros(0, np.int64)])
        self.size = np.repeat(np.minimum(lengths, WINDOW), self.counts)
        self.n_windows = len(self.begin)

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """(which windows, places of their words, mask of short ones) in pieces."""
        for full in (True, False):
            some = np.flatnonzero((self.size == WINDOW) == full)
            for at in range(0, len(some), 4096):
                rows = some[at : at + 4096]
                place = self.begin[rows, None] + np.minimum(np.arange(WINDOW), self.size[rows, None] - 1)
                yield rows, self.flat[place], None if full else np.arange(WINDOW) < self.size[rows, None]


class Network:
    """Parameters: word, char (embeddings), W/b/U of both directions (z, r, n side by side), q (attention), w, c (output)."""

    def __init__(self, vocabulary: dict[bytes, int], seed: int = 0, stride: int = STRIDE):
        draw, d = np.random.default_rng(seed), WORD_SIZE + 2 * CHAR_SIZE
        new = lambda *shape, s: draw.normal(0, s, shape).astype(np.float32)
        self.vocabulary, self.stride = vocabulary, stride
        self.p = {"word": new(len(vocabulary) + 1, WORD_SIZE, s=0.1), "char": new(CHAR_BUCKETS, CHAR_SIZE, s=0.1), "begin": new(BEGIN_BUCKETS, CHAR_SIZE, s=0.1), "q": new(2 * HIDDEN, s=0.3), "w": new(2 * HIDDEN, s=0.3), "c": np.zeros(1, np.float32)}
        for k in "fb":
            self.p |= {f"W{k}": new(d, 3 * HIDDEN, s=d**-0.5), f"U{k}": new(HIDDEN, 3 * HIDDEN, s=HIDDEN**-0.5), f"b{k}": np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, words: list[bytes], hashed: tuple | None = None) -> np.ndarray:
        """One row for each word; hashed is hashes_of(words), where it is made already."""
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        codes, starts, sizes, first, many = hashed or hashes_of(words)
        from_first = np.add.reduceat(self.p["begin"][first], np.concatenate([[0], np.cumsum(many)[:-1]]), axis=0) / many[:, None].astype(np.float32)
        return np.hstack([self.p["word"][ids], np.add.reduceat(self.p["char"][codes], starts, axis=0) / sizes, from_first])

    def forward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray | None = None, keep: bool = False):
        """Logits of windows; index (windows, WINDOW) points to rows of x. keep: also what backward needs."""
        p, (n, length) = self.p, index.shape
        columns = np.ascontiguousarray(index.T)
        on = None if mask is None else np.ascontiguousarray(mask.T)[:, :, None].astype(np.float32)
        states, tape = [], {}
        for k in "fb":
            a, h, own, steps = x @ p[f"W{k}"] + p[f"b{k}"], np.zeros((n, HIDDEN), np.float32), [None] * length, []
            for t in range(length) if k == "f" else range(length - 1, -1, -1):
                u, at = h @ p[f"U{k}"], a[columns[t]]
                gates = _sigmoid(at[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
                m = np.tanh(at[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                new = m + z * (h - m)
                if on is not None:
                    new = h + on[t] * (new - h)
                if keep:
                    steps.append((t, h, z, r, m, u[:, 2 * HIDDEN :]))
                own[t] = h = new
            states.append(np.stack(own))
            tape[k] = steps
        s = np.concatenate(states, axis=2)
        e = s @ p["q"]
        if mask is not None:
            e = np.where(mask.T, e, -1e9)
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, s)
        logits = pooled @ p["w"] + p["c"][0]
        return (logits, (tape, on, s, weight, pooled, columns)) if keep else logits

    def backward(self, x: np.ndarray, kept, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of all but the embeddings, and of the rows of x."""
        p, (tape, on, s, weight, pooled, columns) = self.p, kept
        g = {"w": pooled.T @ dlogit, "c": dlogit.sum(keepdims=True)}
        dpooled = dlogit[:, None] * p["w"]
        dweight = np.einsum("bh,tbh->tb", dpooled, s)
        de = weight * (dweight - (weight * dweight).sum(axis=0))
        g["q"] = np.einsum("tb,tbh->h", de, s)
        ds = weight[:, :, None] * dpooled + de[:, :, None] * p["q"]
        dx = np.zeros_like(x)
        for k in "fb":
            own = ds[:, :, :HIDDEN] if k == "f" else ds[:, :, HIDDEN:]
            dh, da_rows, dU = 0.0, np.zeros((len(x), 3 * HIDDEN), np.float32), 0.0
            for t, h, z, r, m, un in reversed(tape[k]):
                dh = dh + own[t]
                dnew = dh if on is None else on[t] * dh
                back = dnew * z if on is None else dnew * z + (1 - on[t]) * dh
                dm = dnew * (1 - z) * (1 - m * m)
                dz = dnew * (h - m) * z * (1 - z)
                dr = dm * un * r * (1 - r)
                du = np.hstack([dz, dr, dm * r])
                dU = dU + h.T @ du
                np.add.at(da_rows, columns[t], np.hstack([dz, dr, dm]))
                dh = back + du @ p[f"U{k}"].T
            g |= {f"U{k}": dU, f"W{k}": x.T @ da_rows, f"b{k}": da_rows.sum(axis=0)}
            dx += da_rows @ p[f"W{k}"].T
        return g, dx

    def text_logits(self, texts: list[bytes | None], laid: Laid | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each text's highest logit (without words: the output's bias), and all its windows' logits."""
        laid = laid or Laid(texts, self.stride)
        if not laid.words:
            return np.full(len(texts), self.p["c"][0], np.float32), [np.zeros(0, np.float32)] * len(texts)
        x = self.inputs(laid.words, laid.hashed)
        logits = np.empty(laid.n_windows, np.float32)
        for rows, index, mask in laid.windows():
            logits[rows] = self.forward(x, index, mask)
        parts = np.split(logits, np.cumsum(laid.counts)[:-1])
        return np.array([w.max() if len(w) else self.p["c"][0] for w in parts], np.float32), parts

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return _sigmoid(self.text_logits(texts)[0].astype(np.float64))


class _Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def train(texts: list[bytes | None], toxic: list[int], seed: int = 0, settings: Settings = DEFAULT) -> Network:
    """A network for labelled texts. Without both labels its scores are the share of toxic rows."""
    one: dict[bytes, bytes] = {}  # a word is held once, however often it stands
    rows = [([one.setdefault(w, w) for w in words_of(t)], y) for t, y in zip(texts, toxic, strict=True)]
    rows = [(w, y) for w, y in rows if w]
    totals = [Counter(), Counter()]
    for w, y in rows:
        totals[y].update(set(w))
    n = [max(1, sum(y == k for _, y in rows)) for k in (0, 1)]
    known = sorted((w for w in totals[0].keys() | totals[1].keys() if totals[0][w] + totals[1][w] >= settings.min_rows), key=lambda w: (-totals[0][w] - totals[1][w], w))[:MAX_WORDS]
    net = Network({w: i for i, w in enumerate(known, 1)}, seed, settings.stride)
    if {y for _, y in rows} != {0, 1}:
        share = float(np.mean([y for _, y in rows])) if rows else 0.0
        net.p["w"][:] = 0
        net.p["c"][0] = np.log((share + 1e-6) / (1 - share + 1e-6))
        return net
    # Words and trigrams start out with how much likelier they are in toxic rows.
    odds = lambda toxic, clean: 0.5 * np.log((toxic / n[1] + 0.03) / (clean / n[0] + 0.03))
    for w, i in net.vocabulary.items():
        net.p["word"][i, 0] = odds(totals[1][w], totals[0][w])
    for name, codes_of in (("char", trigrams), ("begin", beginnings)):
        held = np.zeros((2, len(net.p[name])))
        for w, y in rows:
            held[y, np.unique(codes_of(w)[0])] += 1
        net.p[name][:, 0] = np.where(held.sum(axis=0) >= settings.min_rows, odds(held[1], held[0]), 0)
    start = {k: net.p[k].copy() for k in ("word", "char", "begin")}
    draw, adam = np.random.default_rng(seed + 1), _Adam(net.p, settings.rate)
    for number in range(settings.rounds):
        logits = net.text_logits([b" ".join(w) for w, _ in rows])[1]
        pool: list[list[tuple[int, int]]] = [[], []]
        for i, ((w, y), own) in enumerate(zip(rows, logits, strict=True)):
            firsts = windows_of(len(w), settings.stride)
            if number == 0:
                odd = net.inputs(w)[:, [0, WORD_SIZE + CHAR_SIZE]].max(axis=1)
                own = np.array([odd[f : f + WINDOW].max() for f in firsts])
            top = np.argsort(-own, kind="stable")
            pool[y] += [(i, int(firsts[j])) for j in top[: 1 if y else 2]]
            if y == 0:
                pool[0].append((i, int(draw.choice(firsts))))
        for _ in range(settings.steps):
            some = [pool[y][j] for y in (0, 1) for j in draw.integers(0, len(pool[y]), BATCH // 2)]
            seen: dict[bytes, int] = {}
            index, mask = np.zeros((len(some), WINDOW), np.int64), np.zeros((len(some), WINDOW), bool)
            for b, (i, first) in enumerate(some):
                part = rows[i][0][first : first + WINDOW]
                index[b, : len(part)] = [seen.setdefault(w, len(seen)) for w in part]
                mask[b, : len(part)] = True
            words = list(seen)
            x = net.inputs(words)
            ids = np.array([net.vocabulary.get(w, 0) for w in words])
            hidden = draw.random(len(words)) < settings.hide  # as if unknown, so that characters count too
            x[hidden, :WORD_SIZE] = net.p["word"][0]
            ids[hidden] = 0
            out, kept = net.forward(x, index, mask, keep=True)
            y = np.array([rows[i][1] for i, _ in some], np.float32)
            g, dx = net.backward(x, kept, ((_sigmoid(out) - (0.02 + 0.96 * y)) / len(some)).astype(np.float32))
            codes, _ = trigrams(words)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            first, many = beginnings(words)
            g |= {k: np.zeros_like(net.p[k]) for k in start}
            np.add.at(g["word"], ids, dx[:, :WORD_SIZE])
            np.add.at(g["char"], codes, np.repeat(dx[:, WORD_SIZE : WORD_SIZE + CHAR_SIZE] / sizes[:, None], sizes, axis=0))
            np.add.at(g["begin"], first, np.repeat(dx[:, WORD_SIZE + CHAR_SIZE :] / many[:, None], many, axis=0))
            adam.rate = settings.rate * (1 - 0.9 * number / settings.rounds)
            adam.step(g)
            for k, x in start.items():
                net.p[k] -= settings.shrink * (net.p[k] - x)
    return net


def held_out() -> Column:
    """Rows that training never sees; a null id is none of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[str, int]]:
    """At most so many toxic rows and CLEAN_TIMES as many clean ones, by a hash of their ids; equal texts of a class once.

    Of rows that repeat an id one text is taken. Texts over TRAIN_CHARS are left out.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    some = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows if y else CLEAN_TIMES * rows) for y in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # at most (1 + CLEAN_TIMES) * rows ids
    short = documents_of(docs).where(F.coalesce(F.char_length("text"), F.lit(0)) <= TRAIN_CHARS)
    found = short.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text")).collect()
    return sorted({(r.text, r.toxic) for r in found})


class Ensemble:
    """Networks of several seeds; a text's logit is the mean of theirs, so that a result hangs less on one start."""

    def __init__(self, networks: list[Network]):
        self.networks = networks

    def text_logits(self, texts: list[bytes | None]) -> np.ndarray:
        laid = Laid(texts, self.networks[0].stride)
        return np.mean([n.text_logits(texts, laid)[0] for n in self.networks], axis=0)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return _sigmoid(self.text_logits(texts).astype(np.float64))


def trained(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seeds: Sequence[int] = SEEDS) -> Ensemble:
    """An ensemble for the labelled rows, made seed by seed in one task, so that an executor holds one training at a time; the bounded sample is sent to it."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(training_sample(docs, labels, rows))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column("id").to_pylist():
                # In a process of its own: what training held goes back with it, where a worker would keep it for later stages.
                with ProcessPoolExecutor(1, mp_context=get_context("fork")) as apart:
                    net = apart.submit(train, [t.encode() for t, _ in shipped.value], [y for _, y in shipped.value], seeds[n]).result()
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([pickle.dumps(net)], pa.binary())], ["id", "network"])

    found = spark.range(0, len(seeds), 1, 1).mapInArrow(run, "id long, network binary").collect()
    return Ensemble([pickle.loads(r.network) for r in sorted(found, key=lambda r: r.id)])


def score_texts(docs: DataFrame, network: Network | Ensemble) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1), predicted (1 from the threshold).

    Texts without words, null ones too, score what the network's output bias gives. Null
    ids and repeated rows are each returned.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shipped.value.scores(utf8(batch.column("text"))))], ["doc_id", "score"])

    scored = documents_of(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, network: Network | Ensemble, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at or above the threshold; all columns stay."""
    shipped = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            yield batch.filter(pa.array(shipped.value.scores(utf8(batch.column("text"))) < threshold))

    return docs.mapInArrow(run, docs.schema)
