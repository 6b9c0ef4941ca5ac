"""Settings of the toxicity network, compared by cross-validation within the rows that it may learn from.

python -m tallyrank.llm.toxicity_trials SF_DIR prints every trial's mean and spread over folds and seeds.
Rows with held_out() are read nowhere here, so what the chosen settings score on them afterwards is
no selection score. A trial's fold is one task: it gets the bounded training sample, trains
on the other folds and scores its own.

A trial's worth is its recall less FALSE_COST times the share of clean rows flagged, both at THRESHOLD.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import replace
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .toxicity import THRESHOLD, Settings, train, training_sample

FOLDS = 4
SEEDS = (0, 1)
FALSE_COST = 4.0
#: Where the trials started; DEFAULT is what won.
START = Settings(rate=0.01)
TRIALS = {
    "start": START,
    "hide .3": replace(START, hide=0.3),
    "hide .5": replace(START, hide=0.5),
    "shrink .005": replace(START, shrink=0.005),
    "shrink .05": replace(START, shrink=0.05),
    "4 rounds": replace(START, rounds=4),
    "10 rounds": replace(START, rounds=10),
    "rate .02": replace(START, rate=0.02),
    "rate .005": replace(START, rate=0.005),
    "2 rows a word": replace(START, min_rows=2),
    "8 rows a word": replace(START, min_rows=8),
    "stride 6": replace(START, stride=6),
}


def cross_validate(spark: SparkSession, sample: Sequence[tuple[str, int]], trials: dict[str, Settings], folds: int = FOLDS, seeds: Sequence[int] = SEEDS) -> DataFrame:
    """(trial, seed, fold, recall, flagged, auc) of every trial; sample as training_sample() gives it.

    Rows fall into folds by a hash of their text. flagged is the share of clean rows at or above the threshold.
    """
    rows = [(t.encode(), y, crc32(t.encode()) % folds) for t, y in sample]
    shipped = spark.sparkContext.broadcast(rows)
    jobs = [(name, seed, fold) for name in trials for seed in seeds for fold in range(folds)]

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for job in part.itertuples():
                rest = [(t, y) for t, y, f in shipped.value if f != job.fold]
                own = [(t, y) for t, y, f in shipped.value if f == job.fold]
                net = train([t for t, _ in rest], [y for _, y in rest], job.seed, trials[job.trial])
                score, y = net.scores([t for t, _ in own]), np.array([y for _, y in own])
                rank = pd.Series(score).rank().to_numpy()
                n = (y == 1).sum()
                auc = (rank[y == 1].sum() - n * (n + 1) / 2) / max(1, n * (len(y) - n))
                yield pd.DataFrame({"trial": [job.trial], "seed": [job.seed], "fold": [job.fold], "recall": [(score[y == 1] >= THRESHOLD).mean()], "flagged": [(score[y == 0] >= THRESHOLD).mean()], "auc": [auc]})

    asked = spark.createDataFrame(jobs, "trial string, seed int, fold int").repartition(len(jobs), "trial", "seed", "fold")
    return asked.mapInPandas(run, "trial string, seed int, fold int, recall double, flagged double, auc double")


def summary(found: DataFrame) -> DataFrame:
    """Mean and spread of each trial over folds and seeds, the worthiest first."""
    worth = F.col("recall") - FALSE_COST * F.col("flagged")
    return found.groupBy("trial").agg(F.count("*").alias("n"), F.avg(worth).alias("worth"), F.stddev(worth).alias("spread"), F.avg("recall").alias("recall"), F.avg("flagged").alias("flagged"), F.avg("auc").alias("auc")).orderBy(F.desc("worth"), "trial")


def main(sf_dir: str) -> None:
    spark = SparkSession.builder.appName("toxicity trials").getOrCreate()
    sample = training_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    print(f"{len(sample)} rows, {sum(y for _, y in sample)} toxic")
    for r in summary(cross_validate(spark, sample, TRIALS)).collect():
        print(f"{r.trial:14} n {r.n}  worth {r.worth:.4f} +- {r.spread:.4f}  recall {r.recall:.4f}  flagged {r.flagged:.4f}  auc {r.auc:.4f}")


if __name__ == "__main__":
    main(sys.argv[1])
