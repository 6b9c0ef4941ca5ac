"""Importance resampling towards a target by hashed n-grams over an integer word dictionary.

Tasks map their distinct words to integers, write n-grams as tuples of these, and hash the
bytes of each distinct tuple once (a distinct word once for as long as its dictionary is
kept); the counts of tuples then come back to their documents as counts of buckets. What
leaves a task is a row for each document, so no word or n-gram is ever shuffled. Counts of
the corpus and of the target are one number for each bucket: they are added up by Spark, and
N_BUCKETS of them, no more, meet on the driver.

A document's weight is the floored mean of its features' gains, its score that weight and
Gumbel noise drawn from its id, so that the best scores are a sample without replacement.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, documents_of, fresh, slices, stored, utf8

N_BUCKETS = 10_000
N_GRAM = 1
SEED = "2024"
MIN_WORDS = 20
PERCENT = 10
#: Words that a task's dictionary keeps from one slice of rows to the next.
KEPT_WORDS = 500_000
#: Texts, and bytes of them or one text, whose words are numbered at once: a word takes some 60 bytes meanwhile.
SLICE_ROWS = 1000
SLICE_BYTES = 1 << 22

# Bytes of words stay (A-Z as a-z), all others of ASCII become spaces.
_WORD_BYTES = bytes(b + 32 if chr(b) in UPPER else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


class Dictionary:
    """Words of a task by integers, and the buckets of the words met so far."""

    def __init__(self, n_gram: int = N_GRAM, n_buckets: int = N_BUCKETS):
        self.n_gram, self.n_buckets = n_gram, n_buckets
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.words: list[bytes] = []
        self.buckets = np.zeros(0, np.int64)

    def _hashed(self, tuples: Iterable[bytes]) -> np.ndarray:
        return np.fromiter(map(crc32, tuples), np.int64) % self.n_buckets

    def read(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, and of all texts their distinct (text, bucket) as three arrays: text, bucket, count."""
        if len(self.ids) > KEPT_WORDS:
            self._clear()
        known = self.ids.__getitem__
        rows = [np.fromiter(map(known, text.translate(_WORD_BYTES).split()), np.int32) if text else np.zeros(0, np.int32) for text in texts]
        self.words.extend(list(self.ids)[len(self.words) :])
        self.buckets = np.concatenate([self.buckets, self._hashed(self.words[len(self.buckets) :])])
        n_words = np.array([len(x) for x in rows], np.int64)
        ids = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)
        owner = np.repeat(np.arange(len(rows)), n_words)
        found, code, at = [owner * self.n_buckets + self.buckets[ids]], ids, np.arange(len(ids))
        for n in range(2, self.n_gram + 1):
            # A tuple is the tuple one word shorter (numbered densely) and its last word.
            inside = at + n - 1 < len(ids)
            inside[inside] = owner[at[inside]] == owner[at[inside] + n - 1]
            at, code = at[inside], code[inside]
            _, first, code = np.unique(code * (len(self.words) + 1) + ids[at + n - 1], return_index=True, return_inverse=True)
            made = self._hashed(b" ".join([self.words[i] for i in ids[a : a + n].tolist()]) for a in at[first].tolist())
            found.append(owner[at] * self.n_buckets + made[code])
        pairs, counts = np.unique(np.concatenate(found), return_counts=True)
        return n_words, pairs // self.n_buckets, pairs % self.n_buckets, counts


_FEATURES = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>"


def features(docs: DataFrame, n_gram: int = N_GRAM, n_buckets: int = N_BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets, counts): each row's buckets and how many features fall into each.

    Words are [a-z0-9] and everything beyond ASCII, A-Z lower-cased; null and empty texts have none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Dictionary(n_gram, n_buckets)
        for batch in slices(batches, SLICE_ROWS, SLICE_BYTES):
            n_words, text, bucket, count = words.read(utf8(batch.column("text")))
            n_features = np.bincount(text, weights=count, minlength=batch.num_rows).astype(np.int64)
            ends = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (bucket, count)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(n_features), *lists], ["doc_id", "n_words", "n_features", "buckets", "counts"])

    return documents_of(docs).mapInArrow(run, _FEATURES)


def bucket_counts(rows: DataFrame) -> DataFrame:
    """(bucket, n) over all rows of features()."""
    met = rows.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return met.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS) -> np.ndarray:
    """Each bucket's gain from the (bucket, n) of corpus and target: at most n_buckets rows of each are fetched."""
    (s, t) = (dict(c.collect()) for c in (corpus, target))
    big_s, big_t = sum(s.values()) + n_buckets, sum(t.values()) + n_buckets
    return np.array([math.floor(1000 * math.log(((t.get(b, 0) + 1) * big_s) / ((s.get(b, 0) + 1) * big_t))) for b in range(n_buckets)], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the features' gains, 0 without features."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, count = (batch.column(c) for c in ("buckets", "counts"))
            sums = np.concatenate([[0], np.cumsum(gain[np.asarray(bucket.flatten())] * np.asarray(count.flatten()))])
            ends = np.concatenate([[0], np.cumsum(np.asarray(bucket.value_lengths()))]).astype(np.int64)
            n = np.asarray(batch.column("n_features"))
            weight = np.where(n > 0, np.diff(sums[ends]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths from the id; rows without an id share that of the empty id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def drawn(scored: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """scored (doc_id, n_words, score, ...) with rank: 1, 2, 3 in order of score, then doc_id, for the best percent.

    Only rows of min_words are drawn and counted. Rows are numbered within ranges of the
    order and moved up by the ranges before, so no task sees all of them. Rows without doc_id
    come behind their score's others.
    """
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    able = scored.where(F.col("n_words") >= min_words)
    parts = stored(able.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")  # read again: ranges must not be drawn anew
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(F.lit(1))).alias("__all"))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__before")
    ranked = parts.join(F.broadcast(before), "__part").withColumn("rank", place.cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= F.floor(F.col("__all") * percent / 100), F.col("rank")))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, n_gram: int = N_GRAM, n_buckets: int = N_BUCKETS, seed: str = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs (doc_id, text), drawn towards target (text).

    Null and empty texts, and an empty target, are counted as they are: no features. Repeated
    rows count and are drawn each by itself. A null doc_id keeps its row.
    """
    rows = stored(features(docs, n_gram, n_buckets), "features")
    goal = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n_gram, n_buckets)
    gain = gains(bucket_counts(rows), bucket_counts(goal), n_buckets)
    scored = weighed(rows, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return drawn(stored(scored, "scores"), min_words, percent)


def sample(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The rows of docs that were drawn; rows that share a drawn row's doc_id come along. ranked is resample(docs, ...)."""
    (name,) = fresh(docs, "__chosen")
    chosen = ranked.where("rank is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(chosen, docs["doc_id"].cast("long").eqNullSafe(F.col(name)), "left_semi")
