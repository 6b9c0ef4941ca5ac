"""Settings of the outlier rule, compared on one half of the labelled rows and reported on the other.

python -m tallyrank.llm.quality_trials SF_DIR prints, for every trial, how many low-quality rows that pass
the base rules are rejected and how many others: on the half that chooses, then for the chosen
trial alone on the other half. The halves are by a hash of the doc_id. The method itself sees no
label; the trials differ in the cut-off, in the least deviations that count and in the support.
The last ones (deviations near nothing, a classical estimate) tell what each part does.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .quality import FEATURES, QUANTILE, SUPPORT, chi2_quantile, judge

FALSE_COST = 4.0
QUANTILES = (0.999, 1 - 1e-6, QUANTILE, 1 - 1e-12)
#: (multiplier of the floors, support); the first is where trials start and wins ties.
ESTIMATES = ((1.0, SUPPORT), (0.5, SUPPORT), (2.0, SUPPORT), (1.0, 0.6), (1.0, 0.9), (0.01, SUPPORT), (1.0, 1.0))


def distances(docs: DataFrame, labels: DataFrame, floors: float, support: float) -> DataFrame:
    """(half, low, distance) of the labelled rows that pass the base rules; half 0 chooses."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 0).alias("low"))
    judged = judge(docs, floors=floors, support=support).where("not base_failed")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    return stored(judged.join(known, "doc_id").select(half.alias("half"), "low", "distance"), "trial-distances")


def counts(found: DataFrame, quantile: float, half: int) -> tuple[int, int, int, int]:
    """(low rows rejected, low rows, others rejected, others)."""
    out = F.col("distance") > chi2_quantile(quantile, len(FEATURES)) ** 0.5
    n = lambda c: F.count(F.when(c, 1))
    return tuple(found.where(F.col("half") == half).agg(n(out & F.col("low")), n(F.col("low")), n(out & ~F.col("low")), n(~F.col("low"))).first())


def worth(c: tuple[int, int, int, int]) -> float:
    return c[0] / max(1, c[1]) - FALSE_COST * c[2] / max(1, c[3])


def main(sf_dir: str) -> None:
    spark = SparkSession.builder.appName("quality trials").getOrCreate()
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    best = None
    for floors, support in ESTIMATES:
        found = distances(docs, labels, floors, support)
        for quantile in (QUANTILE, *(q for q in QUANTILES if q != QUANTILE)):
            c = counts(found, quantile, 0)
            print(f"floors x{floors} support {support} 1 - quantile {1 - quantile:.0e}: rejected {c[0]} of {c[1]} low, {c[2]} of {c[3]} others; worth {worth(c):.4f}", flush=True)
            if best is None or worth(c) > best[0]:
                best = worth(c), floors, support, quantile, found
    c = counts(best[4], best[3], 1)
    print(f"chosen: floors x{best[1]} support {best[2]} 1 - quantile {1 - best[3]:.0e}; other half: rejected {c[0]} of {c[1]} low, {c[2]} of {c[3]} others")


if __name__ == "__main__":
    main(sys.argv[1])
