"""Quality rules over text statistics, then robust outliers per language and source.

Fixed rules fail a text first. The texts that pass are described by transformed rates, and
each language and source gets a minimum-covariance-determinant estimate over all its
rows: chunks of bounded size run the full search from random starts, their estimates are
averaged into a start for the whole group, and concentration steps over all rows
refine it. A step is one aggregation: rows are binned by Mahalanobis distance, each bin
adds up count, sums and products, and the bins that hold the nearest share of a group give
the next estimate. Steps go on until no group's determinant falls any more. No group is
gathered in one task, whatever its size; equal rows are counted before they are dealt to chunks.

Rows of a group too small for an estimate of its own are judged by that of their whole language,
large groups included, or if that is small too by that of the whole corpus: no row stays unjudged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, slices, stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: The share of a group's rows that an estimate is made of.
SUPPORT = 0.75
CHUNK_ROWS = 2000
#: Smaller groups are judged by their language's estimate, smaller languages by the corpus's.
MIN_GROUP = 100
#: Steps end when the logarithm of no group's determinant falls by more than this, or after so many.
SETTLED = 0.01
MAX_STEPS = 30
STARTS = 20
#: A row is rejected beyond this quantile of the distance that a normal population would have.
QUANTILE = 1 - 1e-9
BINS_PER_OCTAVE = 8

#: Transformed statistics and the least standard deviation that counts for each.
FEATURES = {"x_length": 0.06, "x_symbols": 0.06, "x_lines": 0.12, "x_repeats": 0.12, "x_upper": 0.06, "x_marks": 0.06}
_NAMES = list(FEATURES)
_D = len(_NAMES)
_FLOOR = np.array(list(FEATURES.values())) ** 2
_PAIRS = [(i, j) for i in range(_D) for j in range(i, _D)]

_UPPER = bytes(range(65, 91))
_MARKS = bytes(c for c in range(33, 127) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that stand twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 1_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, where, times = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    often = times[where] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= often
    return int(hit.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text; a null text is empty."""
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(data) - len(data.translate(None, _UPPER)),
        len(data) - len(data.translate(None, _MARKS)),
    )


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            counts = np.array([text_counts(x) for x in batch.column("text").to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *map(pa.array, counts.T.copy())], ["doc_id", "lang", "source", *COUNTS])

    return own.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def _features() -> list[Column]:
    """Rates on scales where their spread hardly depends on their size: logarithm, square root."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    made = (F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_upper", "word_chars"), share("n_marks", "word_chars"))
    return [x.cast("double").alias(c) for x, c in zip(made, _NAMES, strict=True)]


def chi2_quantile(p: float, d: int) -> float:
    """Wilson and Hilferty's approximation."""
    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * (2 / (9 * d)) ** 0.5) ** 3


def _floored(cov: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """cov with at least the floor's variance in every direction, not along the axes alone: else a
    far row that correlates the features would make the determinant small."""
    unit = np.sqrt(np.outer(floor, floor))
    size, way = np.linalg.eigh(cov / unit)
    return (way * np.maximum(size, 1.0)) @ way.T * unit


def concentrate(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, h: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One concentration step: the moments of the h rows nearest to (mean, cov)."""
    off = x - mean
    d2 = np.einsum("ij,ij->i", off @ np.linalg.inv(cov), off)
    near = x[np.argpartition(d2, h - 1)[:h]]
    return near.mean(axis=0), _floored(np.cov(near, rowvar=False, bias=True).reshape(x.shape[1], -1), floor)


def fast_mcd(x: np.ndarray, support: float = SUPPORT, starts: int = STARTS, floor: np.ndarray = _FLOOR) -> tuple[np.ndarray, np.ndarray]:
    """The subset moments of least determinant: random starts, two steps each, the best five to the end."""
    n, d = x.shape
    h = min(n, max(int(np.ceil(support * n)), (n + d + 1) // 2))
    x = x[np.lexsort(x.T)]  # any order of rows gives the same estimate
    draw, tried = np.random.default_rng(0), []
    for _ in range(starts):
        some = x[draw.choice(n, min(n, d + 1), replace=False)]
        now = some.mean(axis=0), _floored(np.cov(some, rowvar=False, bias=True).reshape(d, -1), floor)
        for _ in range(2):
            now = concentrate(x, *now, h, floor)
        tried.append((np.linalg.slogdet(now[1])[1], *now))
    best = None
    for det, mean, cov in sorted(tried, key=lambda t: t[0])[:5]:
        for _ in range(30):
            mean, cov = concentrate(x, mean, cov, h, floor)
            after = np.linalg.slogdet(cov)[1]
            if after >= det - 1e-9:
                break
            det = after
        if best is None or after < best[0]:
            best = after, mean, cov
    return best[1], best[2]


def _pools(rows: DataFrame) -> DataFrame:
    """(p_lang, p_source, pool, feeds): what a group is judged by, and every pool whose estimate its rows are part of."""
    name = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    sizes = stored(rows.groupBy("lang", "source").agg(F.count("*").alias("n")), "group-sizes")
    small = F.col("n") < MIN_GROUP
    langs = stored(sizes.groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("n_lang"), F.max(small).alias("some_small")), "language-sizes")
    whole = not langs.where((F.col("n_lang") < MIN_GROUP) & F.col("some_small")).isEmpty()
    by_lang = F.col("some_small") & (F.col("n_lang") >= MIN_GROUP)
    met = sizes.join(langs, F.col("lang").eqNullSafe(F.col("l")))
    pool = F.when(~small, name("lang", "source")).when(by_lang, name("lang")).otherwise(F.lit("whole"))
    feeds = F.array_compact(F.array(F.when(~small, name("lang", "source")), F.when(by_lang, name("lang")), F.lit("whole" if whole else None)))
    return stored(met.select(F.col("lang").alias("p_lang"), F.col("source").alias("p_source"), pool.alias("pool"), feeds.alias("feeds")), "pools")


_ESTIMATE = "pool string, mean array<double>, cov array<double>, prec array<double>, scale double, det double"


def _row(pool: str, mean: np.ndarray, cov: np.ndarray, scale: float = 1.0) -> pd.DataFrame:
    return pd.DataFrame({"pool": [pool], "mean": [mean.tolist()], "cov": [cov.ravel().tolist()], "prec": [np.linalg.inv(cov).ravel().tolist()], "scale": [scale], "det": [float(np.linalg.slogdet(cov)[1])]})


def _distance() -> Column:
    """The squared distance of the row's features from its pool's estimate, as one expression."""
    off = [F.col(c) - F.col("mean")[i] for i, c in enumerate(_NAMES)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + off[i] * off[j] * F.col("prec")[i * _D + j] * (1 if i == j else 2)
    return F.greatest(total, F.lit(0.0))


def _dealt(rows: DataFrame) -> DataFrame:
    """(pool, chunk, w, features): rows dealt to chunks of CHUNK_ROWS or so, w equal rows as one.

    Equal rows are spread evenly over as many chunks as there are, so copies without end are no hot chunk.
    """
    # Stored, its size is known before the join is planned: a small table is sent to the rows, a large one met by splittable shuffles.
    sizes = stored(rows.groupBy("pool").agg(F.ceil(F.count("*") / CHUNK_ROWS).alias("chunks")), "pool-sizes")
    equal = rows.groupBy("pool", "doc_id", *_NAMES).agg(F.count("*").alias("n"))
    met = equal.join(sizes, "pool").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", "chunks") - 1)))
    share = F.floor(F.col("n") / F.least("n", "chunks")) + (F.col("at") < F.col("n") % F.least("n", "chunks")).cast("long")
    return met.select("pool", F.pmod(F.xxhash64("doc_id", *_NAMES) + F.col("at"), "chunks").alias("chunk"), share.alias("w"), *_NAMES)


def _chunk_estimates(rows: DataFrame, floor: np.ndarray, support: float) -> DataFrame:
    """The average of the chunks' estimates per pool, by their rows."""
    dealt = _dealt(rows)

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = np.repeat(part[_NAMES].to_numpy(), part["w"].to_numpy(), axis=0)
        mean, cov = fast_mcd(x, support, floor=floor)
        return _row(key[0], mean, cov, float(len(x)))

    # Without this the join's partitions by pool would serve, and a pool's chunks share one task.
    fits = dealt.repartition("pool", "chunk").groupBy("pool", "chunk").applyInPandas(fit, _ESTIMATE)
    weighed = lambda c, i: (F.sum(F.col(c)[i] * F.col("scale")) / F.sum("scale"))
    return fits.groupBy("pool").agg(F.array(*(weighed("mean", i) for i in range(_D))).alias("mean"), F.array(*(weighed("cov", i) for i in range(_D * _D))).alias("cov"))


def _with_precision(estimates: DataFrame) -> DataFrame:
    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                yield _row(r.pool, np.array(r.mean), np.array(r.cov).reshape(_D, _D))

    return estimates.mapInPandas(run, _ESTIMATE)


def _step(rows: DataFrame, estimates: DataFrame, floor: np.ndarray = _FLOOR, support: float = SUPPORT) -> DataFrame:
    """One concentration step of every pool over all its rows.

    The nearest bins that hold the support are taken whole, at most 2 ** (1 / 8) wide in
    squared distance. scale makes the median squared distance what a normal population has.
    """
    seen = rows.join(estimates, "pool").select("pool", *_NAMES, _distance().alias("d2"))
    binned = seen.withColumn("bin", F.floor(F.log2(F.greatest("d2", F.lit(2.0**-20))) * BINS_PER_OCTAVE).cast("int"))
    sums = binned.groupBy("pool", "bin").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(_NAMES)), *(F.sum(F.col(_NAMES[i]) * F.col(_NAMES[j])).alias(f"p{i}_{j}") for i, j in _PAIRS))

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bin")
        total = part["n"].cumsum().to_numpy()
        last = int(np.searchsorted(total, support * total[-1]))
        near, n = part.iloc[: last + 1], total[last]
        mean = near[[f"s{i}" for i in range(_D)]].sum().to_numpy() / n
        cov = np.empty((_D, _D))
        for i, j in _PAIRS:
            cov[i, j] = cov[j, i] = near[f"p{i}_{j}"].sum() / n - mean[i] * mean[j]
        middle = int(np.searchsorted(total, 0.5 * total[-1]))
        scale = 2.0 ** ((part["bin"].iloc[middle] + 1) / BINS_PER_OCTAVE) / chi2_quantile(0.5, _D)
        return _row(key[0], mean, _floored(cov, floor), max(1.0, scale))

    return sums.groupBy("pool").applyInPandas(fit, _ESTIMATE)


def _settled(rows: DataFrame, start: DataFrame, floor: np.ndarray, support: float) -> DataFrame:
    """Concentration steps until no pool's determinant falls; a pool keeps its estimate of least determinant."""
    now = start
    for _ in range(MAX_STEPS):
        after = _step(rows, now, floor, support)
        old = now.select("pool", F.struct("det", "mean", "cov", "prec", "scale").alias("old"))
        met = after.join(old, "pool").withColumn("fell", F.col("old.det") - F.col("det"))
        better = lambda c: F.when(F.col("fell") > 0, F.col(c)).otherwise(F.col(f"old.{c}")).alias(c)
        met = stored(met.select("pool", *(better(c) for c in ("mean", "cov", "prec", "scale", "det")), "fell"), "estimates")
        now = met.drop("fell")
        if (met.agg(F.max("fell")).first()[0] or 0.0) <= SETTLED:
            break
    return now


def judge(docs: DataFrame, quantile: float = QUANTILE, floors: float = 1.0, support: float = SUPPORT) -> DataFrame:
    """Per row of docs: doc_id, the counts, base_failed, distance (null where base_failed), kept.

    A null or empty text has no words and fails the base rules. Null languages and
    sources are groups of their own. Repeated rows count as often as they occur. floors
    multiplies the least deviations of FEATURES, support is the share of rows an estimate is made of.
    """
    floor = _FLOOR * floors**2
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    counted = stored(text_statistics(docs).select("*", failed.alias("base_failed"), *_features()), "text-statistics")
    passed = counted.where("not base_failed")
    pools = _pools(passed)
    same = F.col("lang").eqNullSafe(F.col("p_lang")) & F.col("source").eqNullSafe(F.col("p_source"))
    pooled = stored(passed.join(pools, same).drop("p_lang", "p_source"), "pooled-statistics")
    rows = pooled.select(F.explode("feeds").alias("pool"), "doc_id", *_NAMES)
    start = stored(_with_precision(_chunk_estimates(rows, floor, support)), "estimates")
    now = _settled(rows, start, floor, support)
    # The median of the last estimate's own distances scales it.
    scales = _step(rows, now, floor, support).select("pool", F.col("scale").alias("by"))
    final = stored(now.join(scales, "pool"), "estimates")
    limit = chi2_quantile(quantile, _D)
    judged = pooled.join(final, "pool").withColumn("distance", F.sqrt(_distance() / F.col("by")))
    judged = judged.select("doc_id", *COUNTS, "base_failed", "distance", (F.col("distance") <= limit**0.5).alias("kept"))
    return judged.unionByName(counted.where("base_failed").select("doc_id", *COUNTS, "base_failed", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")))
