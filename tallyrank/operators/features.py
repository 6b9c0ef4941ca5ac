"""Item features in long form: (product_id, feature, value).

Four blocks: TF-IDF of words and word pairs, TF-IDF of character n-grams, the taxonomy as
one-hot, and standardised numbers. All are aggregates of Column expressions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import char_ngrams, item_text, word_ngrams
from ..session import checkpointed
from .sparse import block_count, cosines, packed

WORD_MIN_DF = 2
CHAR_MIN_DF = 3
#: Products of a task that makes terms: a catalogue's file is small, its terms are not.
TERM_PRODUCTS = 2048
#: Terms of a vocabulary that is sent to the counts; a larger one is met by a shuffle.
BROADCAST_TERMS = 100_000
#: Vectors of a block in nearest-vector search: each moves once for every block that it meets. Cosines of a tile made at once.
TILE_VECTORS = 16384
TILE_COSINES = 1 << 22
# What each block weighs in an item's vector.
BLOCK_WEIGHTS = {"word": 1.0, "char": 0.4, "taxonomy": 0.6, "numeric": 0.25}
TAXONOMY = ("category", "subcategory", "brand")
NUMERIC = ("log_price", "rating", "log_rating_count")


def l2_normalize(rows: DataFrame, key: str = "product_id", value: str = "value") -> DataFrame:
    """value divided by the length of its key's vector; zero vectors stay zero."""
    length = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(key)))
    return rows.withColumn(value, F.when(length > 0, F.col(value) / length).otherwise(F.col(value)))


def terms(products: DataFrame, grams: Column) -> DataFrame:
    """(product_id, term, n) of an array column over item_text.

    Texts are dealt out by product before they are taken apart, so no term is shuffled to be counted.
    """
    texts = products.select("product_id", item_text().alias("text")).repartition(min(block_count(products, TERM_PRODUCTS), 10_000), "product_id")
    return texts.select("product_id", F.explode(grams).alias("term")).groupBy("product_id", "term").agg(F.count("*").alias("n"))


def word_terms(products: DataFrame) -> DataFrame:
    return terms(products, word_ngrams(F.col("text")))


def char_terms(products: DataFrame) -> DataFrame:
    return terms(products, char_ngrams(F.col("text")))


def inverse_frequencies(counts: DataFrame, products: DataFrame, min_df: int) -> DataFrame:
    """(term, idf) of the terms that min_df products or more have: ln((1 + N) / (1 + df)) + 1. Stored, since it is counted and read."""
    df = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    n_docs = products.agg(F.count("*").alias("n_docs"))
    return checkpointed(df.crossJoin(F.broadcast(n_docs)).select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf")))  # one row


def weighed_terms(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(product_id, term, value): (1 + ln n) * idf of the terms that idf knows, unit rows."""
    idf = F.broadcast(idf) if idf.count() <= BROADCAST_TERMS else idf
    return l2_normalize(counts.join(idf, "term").select("product_id", "term", ((1 + F.log("n")) * F.col("idf")).alias("value")))


def tfidf(counts: DataFrame, products: DataFrame, min_df: int) -> DataFrame:
    """(product_id, term, value): (1 + ln n) * (ln((1 + N) / (1 + df)) + 1), unit rows."""
    return weighed_terms(counts, inverse_frequencies(counts, products, min_df))


def numeric_features(products: DataFrame) -> DataFrame:
    """product_id, log_price, rating, log_rating_count with their defaults and floors."""
    return products.select(
        "product_id",
        F.log1p(F.greatest(F.col("price").try_cast("double"), F.lit(0.01))).alias("log_price"),
        F.coalesce(F.col("rating").try_cast("double"), F.lit(3.5)).alias("rating"),
        F.log1p(F.greatest(F.coalesce(F.col("rating_count").try_cast("double"), F.lit(0.0)), F.lit(0.0))).alias("log_rating_count"),
    )


def scaled_numeric(products: DataFrame) -> DataFrame:
    """(product_id, feature, value): the absolute distance from the mean in population deviations."""
    return standardised(products, number_stats(products))


def number_stats(products: DataFrame) -> DataFrame:
    """One row: the mean and the population deviation of each number."""
    return numeric_features(products).agg(*(f(c).alias(f"{name}_{c}") for c in NUMERIC for name, f in (("mean", F.avg), ("std", F.stddev_pop))))


def standardised(products: DataFrame, stats: DataFrame) -> DataFrame:
    """(product_id, feature, value) of the numbers by stats, the one row of number_stats()."""
    numbers = numeric_features(products)
    met = numbers.crossJoin(F.broadcast(stats))  # one row
    made = [F.struct(F.lit(c).alias("feature"), F.abs((F.col(c) - F.col(f"mean_{c}")) / F.when(F.col(f"std_{c}") > 0, F.col(f"std_{c}")).otherwise(1.0)).alias("value")) for c in NUMERIC]
    return met.select("product_id", F.explode(F.array(*made)).alias("f")).select("product_id", "f.feature", "f.value")


def taxonomy_onehot(products: DataFrame) -> DataFrame:
    """(product_id, feature, value 1) for each level of the taxonomy; null is a value of its own, empty."""
    made = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c), F.lit(""))) for c in TAXONOMY]
    return products.select("product_id", F.explode(F.array(*made)).alias("feature"), F.lit(1.0).alias("value"))


def item_features(products: DataFrame) -> DataFrame:
    """The weighted blocks beside one another, unit rows, without zeros."""
    products = products.repartition(min(block_count(products, TERM_PRODUCTS), 10_000), "product_id")
    return side_by_side(
        {
            "word": tfidf(word_terms(products), products, WORD_MIN_DF).withColumnRenamed("term", "feature"),
            "char": tfidf(char_terms(products), products, CHAR_MIN_DF).withColumnRenamed("term", "feature"),
            "taxonomy": taxonomy_onehot(products),
            "numeric": scaled_numeric(products),
        }
    )


def side_by_side(blocks: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, block in blocks.items():
        part = block.select("product_id", F.concat(F.lit(f"{name}:"), "feature").alias("feature"), (F.col("value") * BLOCK_WEIGHTS[name]).alias("value"))
        out = part if out is None else out.unionByName(part)
    return l2_normalize(out.where("value != 0"))


class FittedFeatures:
    """What a catalogue teaches about its features, so that single items can be described by it later.

    terms (block, term, idf) is the vocabulary with its weights, levels (feature) the taxonomy's values, stats
    one row of means and deviations. Describing all of the catalogue gives item_features() again.
    """

    TABLES = ("terms", "levels", "stats", "items")

    def __init__(self, terms: DataFrame, levels: DataFrame, stats: DataFrame, items: DataFrame):
        self.terms, self.levels, self.stats, self.items = terms, levels, stats, items

    @classmethod
    def fit(cls, products: DataFrame) -> FittedFeatures:
        words = inverse_frequencies(word_terms(products), products, WORD_MIN_DF).withColumn("block", F.lit("word"))
        chars = inverse_frequencies(char_terms(products), products, CHAR_MIN_DF).withColumn("block", F.lit("char"))
        made = words.unionByName(chars), taxonomy_onehot(products).select("feature").distinct(), number_stats(products), products
        return cls(*map(checkpointed, made))

    def save(self, path: str) -> None:
        for name in self.TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedFeatures:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in cls.TABLES))

    def transform(self, products: DataFrame) -> DataFrame:
        """(product_id, feature, value) of any products, known or new; terms and levels that fitting did not meet are left out."""
        of = lambda block: self.terms.where(F.col("block") == block).select("term", "idf")
        return side_by_side(
            {
                "word": weighed_terms(word_terms(products), of("word")).withColumnRenamed("term", "feature"),
                "char": weighed_terms(char_terms(products), of("char")).withColumnRenamed("term", "feature"),
                "taxonomy": taxonomy_onehot(products).join(self.levels, "feature", "left_semi").select("product_id", "feature", "value"),
                "numeric": standardised(products, self.stats),
            }
        )

    def describe(self, product_ids: Sequence[str]) -> DataFrame:
        """transform() of the catalogue's items named; KeyError for the first that it lacks."""
        own = self.items.where(F.col("product_id").isin(list(product_ids)))
        known = {r.product_id for r in own.select("product_id").collect()}  # at most those asked for
        for p in product_ids:
            if p not in known:
                raise KeyError(p)
        return self.transform(own)

    def dense(self, product_ids: Sequence[str]) -> tuple[list[str], np.ndarray]:
        """The names of all features in order, and a row of numbers for each item named, in the order asked."""
        rows = self.describe(product_ids).collect()
        names = self.terms.select(F.concat("block", F.lit(":"), "term").alias("f")).unionByName(self.levels.select(F.concat(F.lit("taxonomy:"), "feature").alias("f")))
        columns = sorted([r.f for r in names.collect()] + [f"numeric:{c}" for c in NUMERIC])  # the vocabulary, as wide as each row
        place, row = {f: n for n, f in enumerate(columns)}, {p: n for n, p in enumerate(product_ids)}
        out = np.zeros((len(product_ids), len(columns)))
        for r in rows:
            out[row[r.product_id], place[r.feature]] = r.value
        return columns, out[[row[p] for p in product_ids]]


def vector_for(features: DataFrame, product_id: str) -> DataFrame:
    """(feature, value) of one item; KeyError if it has none."""
    own = features.where(F.col("product_id") == product_id).select("feature", "value")
    if not own.take(1):
        raise KeyError(product_id)
    return own


def vectors_for(features: DataFrame, product_ids: Sequence[str]) -> DataFrame:
    """(product_id, feature, value) of the items named; KeyError for the first that has none."""
    own = features.where(F.col("product_id").isin(list(product_ids)))
    known = {r.product_id for r in own.select("product_id").distinct().collect()}  # at most those asked for
    for p in product_ids:
        if p not in known:
            raise KeyError(p)
    return own


def feature_counts(features: DataFrame) -> DataFrame:
    """One row: n_items with features, and n_features, the words and character n-grams in use."""
    text = F.col("feature").startswith("word:") | F.col("feature").startswith("char:")
    return features.agg(F.count_distinct("product_id").alias("n_items"), F.count_distinct(F.when(text, F.col("feature"))).alias("n_features"))


def item_cosine(features: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(i, j, cos) of every item i with the items j (all, or those named) that it shares a feature with: feature rows are unit rows."""
    left = packed(features)
    return cosines(left, left if items is None else left.join(items.select("product_id").distinct(), "product_id", "left_semi"))


def embedding_topk(vectors: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, vec_id, cosine, rank): each query's k nearest other vectors by cosine, ties by vec_id.

    queries (vec_id, embedding) are the vectors themselves by default. Blocks of queries meet
    blocks of vectors, one matrix product a tile, and only the k best per query leave a tile.
    Null embeddings are left out; a vector of zeros has cosine 0 with all.
    """

    def packed(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        rows = rows.where("embedding is not null")
        n = -(-rows.count() // TILE_VECTORS) or 1
        named = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(f"{name}_block"), F.col("vec_id").cast("long"), F.col("embedding"))
        return named.groupBy(f"{name}_block").agg(F.collect_list("vec_id").alias(f"{name}_ids"), F.collect_list("embedding").alias(f"{name}_rows")), n

    asked, n_q = packed(queries if queries is not None else vectors, "q")
    held, n_v = packed(vectors, "v")
    tiles = asked.withColumn("v_block", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1)))).join(held, "v_block")

    def unit(rows: pa.Array) -> np.ndarray:
        m = np.asarray(rows.flatten(), np.float64).reshape(len(rows), -1)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q_ids, v_ids = (np.asarray(batch.column(c)[r].values) for c in ("q_ids", "v_ids"))
                order = np.argsort(v_ids, kind="stable")
                v_ids = v_ids[order]
                asked_rows, held_rows = unit(batch.column("q_rows")[r].values), unit(batch.column("v_rows")[r].values)[order]
                step = max(1, TILE_COSINES // len(v_ids))
                for a in range(0, len(q_ids), step):
                    own = q_ids[a : a + step]
                    cosine = asked_rows[a : a + step] @ held_rows.T
                    cosine[own[:, None] == v_ids[None, :]] = -np.inf
                    best = np.argsort(-np.round(cosine, 9), axis=1, kind="stable")[:, :k]
                    value = np.take_along_axis(cosine, best, axis=1).ravel()
                    keep = value > -np.inf
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, best.shape[1])[keep]), pa.array(v_ids[best].ravel()[keep]), pa.array(value[keep])], ["query_id", "vec_id", "cosine"])

    found = tiles.repartition(min(n_q * n_v, 10_000), "q_block", "v_block").mapInArrow(run, "query_id long, vec_id long, cosine double")
    ranked = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
