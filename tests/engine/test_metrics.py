"""Hand-computed metric values."""

from math import log2

import pytest
from pyspark.sql import functions as F

from tallyrank.operators import metrics


def lists(spark, **recs):
    return spark.createDataFrame([(u, p, i) for u, items in recs.items() for i, p in enumerate(items, 1)], "user_id string, product_id string, rank int")


def truth(spark, **sets):
    return spark.createDataFrame([(u, p) for u, items in sets.items() for p in items], "user_id string, product_id string")


def at(spark, recs, relevant, k):
    return metrics.metrics_at_k(lists(spark, u=recs), truth(spark, u=relevant), [k]).first()


def test_precision_and_recall(spark):
    r = at(spark, "abcd", "ace", 4)
    assert r.precision == 2 / 4 and r.recall == pytest.approx(2 / 3)


def test_precision_divides_by_k(spark):
    rows = {r.k: r for r in metrics.metrics_at_k(lists(spark, u="axxc"), truth(spark, u="ac"), [2, 4, 8]).collect()}
    assert (rows[2].precision, rows[4].precision, rows[8].precision) == (0.5, 0.5, 0.25)


def test_ndcg(spark):
    assert at(spark, "xaby", "ab", 4).ndcg == pytest.approx((1 / log2(3) + 1 / log2(4)) / (1 / log2(2) + 1 / log2(3)))


def test_perfect_order(spark):
    r = at(spark, "ab", "ab", 2)
    assert r.ndcg == r.map == r.mrr == r.hit_rate == 1


def test_mrr_and_average_precision(spark):
    assert at(spark, "ab", "b", 2).mrr == 0.5 and at(spark, "ba", "b", 2).mrr == 1
    assert at(spark, "axb", "ab", 3).map == pytest.approx((1 + 2 / 3) / 2)
    none = at(spark, "xy", "a", 2)
    assert none.mrr == none.map == none.ndcg == none.hit_rate == 0


def test_repeats_count_once_for_recall(spark):
    r = at(spark, "aaa", "a", 3)
    assert r.precision == 1 and r.recall == 1


def test_coverage(spark):
    items = spark.createDataFrame([(p,) for p in "abcd"], "product_id string")
    assert metrics.catalog_coverage(lists(spark, u="ab", v="bcz"), items, [2]).first().coverage == 0.75


def test_novelty(spark):
    items = spark.createDataFrame([("a",), ("b",)], "product_id string")
    shares = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "product_id string, share double")
    assert metrics.novelty(lists(spark, u="ab"), shares, items, [2]).first().novelty == 1.5


def test_personalisation(spark):
    one = lambda **r: metrics.personalisation(lists(spark, **r), [2]).first()
    assert one(u="ab", v="cd").personalisation == 1 and one(u="ab", v="ba").personalisation == 0 and one(u="ab").personalisation == 0
    assert one(u="ab", v="bc").personalisation == pytest.approx(1 - 1 / 3)


def test_diversity(spark):
    every = spark.createDataFrame([(i, j, 1.0) for i in "abc" for j in "abc"], "i string, j string, cos double")
    same = every.where(F.col("i") == F.col("j"))
    assert metrics.diversity(lists(spark, u="abc"), every, [3]).first().diversity == 0
    assert metrics.diversity(lists(spark, u="abc"), same, [3]).first().diversity == 1
    assert metrics.diversity(lists(spark, u="a"), same, [3]).first().diversity == 0
