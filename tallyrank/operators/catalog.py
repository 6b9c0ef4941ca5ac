"""Catalogue queries: filters, pages, facets, lookups, profiles, hydration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .interactions import popularity_share


@dataclass(frozen=True)
class CatalogFilters:
    """Conditions that all have to hold; what isn't given holds."""

    category: str | None = None
    brand: str | None = None
    min_price: float | None = None
    max_price: float | None = None
    tags: tuple[str, ...] = ()

    def is_empty(self) -> bool:
        return not (self.category or self.brand or self.tags) and self.min_price is None and self.max_price is None

    def predicate(self) -> Column:
        out = F.lit(True)
        if self.category:
            out &= F.col("category") == self.category
        if self.brand:
            out &= F.col("brand") == self.brand
        if self.min_price is not None:
            out &= F.col("price") >= self.min_price
        if self.max_price is not None:
            out &= F.col("price") <= self.max_price
        if self.tags:
            out &= F.arrays_overlap(F.transform("tags", lambda t: F.lower(t)), F.array(*(F.lit(t.lower()) for t in self.tags)))
        return F.coalesce(out, F.lit(False))

    def apply(self, products: DataFrame) -> DataFrame:
        return products.where(self.predicate())


def search(products: DataFrame, pattern: str) -> DataFrame:
    """The lower-cased pattern, a regular expression, in lower-cased titles or descriptions."""
    found = lambda c: F.coalesce(F.lower(F.col(c)).rlike(pattern.lower()), F.lit(False))
    return products.where(found("title") | found("description"))


def browse(products: DataFrame, limit: int = 50, offset: int = 0, category: str | None = None, brand: str | None = None, pattern: str | None = None) -> DataFrame:
    rows = CatalogFilters(category=category, brand=brand).apply(products)
    if pattern:
        rows = search(rows, pattern)
    return rows.orderBy("product_id").offset(offset).limit(limit)


def lookup(products: DataFrame, product_id: str) -> DataFrame:
    return products.where(F.col("product_id") == product_id).limit(1)


def facets(products: DataFrame) -> DataFrame:
    """(facet, value): the distinct categories, subcategories, brands and tags, and both ends of the prices."""
    made = [F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("category", "subcategory", "brand")]
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("value")))
    values = products.select(F.explode(F.concat(F.array(*made), tags)).alias("f")).select("f.*").where("value is not null").distinct()
    ends = products.agg(F.min("price").alias("a"), F.max("price").alias("b")).select(F.explode(F.array(F.struct(F.lit("price_min").alias("facet"), F.col("a").cast("decimal(18,2)").cast("string").alias("value")), F.struct(F.lit("price_max").alias("facet"), F.col("b").cast("decimal(18,2)").cast("string").alias("value")))).alias("f")).select("f.*")
    return values.unionByName(ends)


def finite(rows: DataFrame) -> DataFrame:
    """rows with null for every number that is none: NaN and both infinities, as replies can't carry them."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ends = (float("inf"), float("-inf"))
    return rows.select(*(F.when(~F.isnan(c) & ~F.col(c).isin(*ends), F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in kinds.items()))


def hydrate(ranked: DataFrame, products: DataFrame, cells: DataFrame) -> DataFrame:
    """ranked (user_id, product_id, score, rank) with the products' columns and share of popularity; unknown ids go."""
    met = ranked.join(products, "product_id").join(popularity_share(cells), "product_id", "left")
    return met.select("user_id", "rank", "product_id", *(c for c in products.columns if c not in ("product_id", "created_at")), F.coalesce("share", F.lit(0.0)).alias("popularity"), F.round("score", 6).alias("score"))


def user_profile(events: DataFrame, products: DataFrame) -> DataFrame:
    """(user_id, n_events, n_distinct_products, price_min, price_max) of all users with events."""
    base = events.groupBy("user_id").agg(F.count("*").alias("n_events"), F.count_distinct("product_id").alias("n_distinct_products"))
    prices = events.join(products.select("product_id", "price"), "product_id").groupBy("user_id").agg(F.min("price").alias("price_min"), F.max("price").alias("price_max"))
    return base.join(prices, "user_id", "left")


def event_type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def top_values(events: DataFrame, products: DataFrame, column: str, k: int = 5) -> DataFrame:
    """Each user's k commonest values of a product column, ties by value."""
    counts = events.join(products.select("product_id", column), "product_id").where(F.col(column).isNotNull()).groupBy("user_id", column).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), column)))
    return ranked.where(F.col("rank") <= k)
