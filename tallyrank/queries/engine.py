"""The engine's queries, each beside the SQL that it has to agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, item_text
from ..functions.weights import event_weight, recency_decay
from ..operators import catalog, content, features, hybrid, interactions, knn, latent, metrics, popularity
from ..operators.ranking import rank_topk
from ..operators.split import segments
from ..plans import evaluate
from ..sources import store
from ..sources.adapters import read, star_events
from .fragments import oracle
from .workspace import Workspace, rounded, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The item that item-to-item queries ask for.
ITEM = "P000000007"
KS = [5, 10, 20]


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, or another where that is taken by what it calls."""

    def register(f: Callable[[Workspace], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(workspace(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = oracle(sql)
        return f

    return register


def micros(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return df.withColumn("us", F.unix_micros(column)).drop(column)


EVENT = ["event_id", "user_id", "product_id", "event_type", "us"]


# Sources and store


@query("SELECT event_id, user_id, product_id, event_type, us FROM ev WHERE us >= epoch_us(TIMESTAMP '2024-01-10 00:00:00')")
def events_since(w: Workspace) -> DataFrame:
    return micros(store.events_since(w.events, "2024-01-10 00:00:00")).select(*EVENT)


@query("SELECT user_id, product_id, count(*)::DOUBLE AS weight, count(*)::BIGINT AS n_events, max(us) AS last_us FROM ev GROUP BY ALL")
def user_product_rollup(w: Workspace) -> DataFrame:
    return store.user_product_rollup(w.events).select("user_id", "product_id", "weight", "n_events", F.unix_micros("last_ts").alias("last_us"))


@query("SELECT 'products' AS table_name, count(*)::BIGINT AS n_rows FROM prod UNION ALL SELECT 'users', count(*) FROM people UNION ALL SELECT 'events', count(*) FROM ev")
def table_counts(w: Workspace) -> DataFrame:
    return store.table_counts(w.products, w.users, w.events)


@query("SELECT product_id, title, CASE WHEN category = 'ECONOMY' THEN price * 2 ELSE price END AS price FROM prod")
def upsert_latest(w: Workspace) -> DataFrame:
    """The catalogue upserted with one category at twice its price."""
    new = w.products.where("category = 'ECONOMY'").withColumn("price", F.col("price") * 2)
    return store.latest(w.products, new, "product_id").select("product_id", "title", "price")


@query("SELECT event_id, user_id, product_id, event_type, us FROM ev WHERE event_type <> 'error'")
def ingest_valid_events(w: Workspace) -> DataFrame:
    """Events whose type is lost on the way in are not valid."""
    damaged = w.events.withColumn("event_type", F.when(F.col("event_type") != "error", F.col("event_type")))
    return micros(store.valid_events(damaged)).select(*EVENT)


@query("""SELECT substr(sha256('products=' || (SELECT count(*) FROM prod) || '|events=' || (SELECT count(*) FROM ev) || '|max_ts=' || (SELECT max(us) FROM ev)
  || '|cols=brand,category,created_at,description,price,product_id,rating,rating_count,subcategory,tags,title'), 1, 12) AS fingerprint""")
def data_fingerprint(w: Workspace) -> DataFrame:
    from ..plans.artifacts import data_fingerprint as made

    return made(w.products, w.events)


# Catalogue


@query("SELECT product_id, title, price FROM prod WHERE category = 'ECONOMY' AND price BETWEEN 950 AND 1400 AND len(list_filter(tags, lambda t: lower(t) IN ('ring', 'bolt'))) > 0")
def catalog_filter(w: Workspace) -> DataFrame:
    return catalog.CatalogFilters(category="ECONOMY", min_price=950, max_price=1400, tags=("Ring", "BOLT")).apply(w.products).select("product_id", "title", "price")


@query("SELECT product_id, title, brand, price FROM prod WHERE category = 'ECONOMY' AND (regexp_matches(lower(title), 'r(ing|ed)') OR regexp_matches(lower(description), 'r(ing|ed)')) ORDER BY product_id LIMIT 20 OFFSET 10")
def browse_page(w: Workspace) -> DataFrame:
    return catalog.browse(w.products, limit=20, offset=10, category="ECONOMY", pattern="R(ing|ed)").select("product_id", "title", "brand", "price")


@query("SELECT product_id, title FROM prod WHERE regexp_matches(lower(title), 'blue|gear$') OR regexp_matches(lower(description), 'blue|gear$')")
def catalog_search(w: Workspace) -> DataFrame:
    return catalog.search(w.products, "Blue|gear$").select("product_id", "title")


@query(f"SELECT product_id, title, description, category, subcategory, brand, price, rating, rating_count FROM prod WHERE product_id = '{ITEM}'")
def product_lookup(w: Workspace) -> DataFrame:
    return catalog.lookup(w.products, ITEM).drop("tags", "created_at")


@query("""SELECT DISTINCT * FROM (SELECT 'category' AS facet, category AS value FROM prod UNION ALL SELECT 'subcategory', subcategory FROM prod UNION ALL SELECT 'brand', brand FROM prod
  UNION ALL SELECT 'tag', unnest(tags) FROM prod UNION ALL SELECT 'price_min', min(price)::DECIMAL(18, 2)::VARCHAR FROM prod UNION ALL SELECT 'price_max', max(price)::DECIMAL(18, 2)::VARCHAR FROM prod)""")
def facets(w: Workspace) -> DataFrame:
    return catalog.facets(w.products)


@query("SELECT event_id, user_id, product_id, event_type, us FROM ev WHERE event_type IN ('add_to_cart', 'purchase', 'wishlist')")
def positive_events(w: Workspace) -> DataFrame:
    return micros(interactions.positive_events(w.events)).select(*EVENT)


@query("""SELECT e.user_id, count(*)::BIGINT AS n_events, count(DISTINCT e.product_id)::BIGINT AS n_distinct_products, min(price) AS price_min, max(price) AS price_max
  FROM ev e LEFT JOIN prod USING (product_id) GROUP BY e.user_id""")
def user_profile(w: Workspace) -> DataFrame:
    return catalog.user_profile(w.events, w.products)


@query("SELECT user_id, event_type, count(*)::BIGINT AS n FROM ev GROUP BY ALL")
def event_type_counts(w: Workspace) -> DataFrame:
    return catalog.event_type_counts(w.events)


def _top(column: str) -> str:
    return f"SELECT user_id, {column}, count(*)::BIGINT AS n, (row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, {column}))::INT AS rank FROM ev JOIN prod USING (product_id) GROUP BY user_id, {column} QUALIFY rank <= 5"


@query(_top("category"))
def profile_top_categories(w: Workspace) -> DataFrame:
    return catalog.top_values(w.events, w.products, "category")


@query(_top("brand"))
def profile_top_brands(w: Workspace) -> DataFrame:
    return catalog.top_values(w.events, w.products, "brand")


@query("""SELECT r.user_id, r.rank::INT AS rank, r.product_id, title, category, round(coalesce(total / (SELECT sum(total) FROM m_pop), 0), 6) AS popularity, round(score, 6) AS score
  FROM m_poprecs r JOIN prod USING (product_id) LEFT JOIN m_pop USING (product_id) WHERE rank <= 10""")
def hydrate_ranked(w: Workspace) -> DataFrame:
    full = catalog.hydrate(w.models.recommend("popularity", 10), w.products, w.models.cells)
    return rounded(full.select("user_id", "rank", "product_id", "title", "category", "popularity", "score"), "popularity")


# Weights and cells


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 1.0 WHEN 'wishlist' THEN 2.0 WHEN 'add_to_cart' THEN 3.0 WHEN 'purchase' THEN 5.0 ELSE 1.0 END::DOUBLE AS weight FROM ev", name="event_weight")
def event_weights(w: Workspace) -> DataFrame:
    return w.events.select("event_id", event_weight(F.col("event_type"), F.col("weight")).alias("weight"))


@query("SELECT event_id, round(power(0.5, greatest(((SELECT max(us) FROM ev) - us) / 86400e6, 0) / 30.0), 6) AS decay FROM ev", name="recency_decay")
def recency_decays(w: Workspace) -> DataFrame:
    latest = w.events.agg(F.max("timestamp").alias("reference"))
    return w.events.crossJoin(F.broadcast(latest)).select("event_id", F.round(recency_decay(F.col("timestamp"), F.col("reference"), 30.0), 6).alias("decay"))  # one row


@query("SELECT user_id, product_id, round(value, 6) AS value FROM im")
def interaction_matrix(w: Workspace) -> DataFrame:
    return rounded(interactions.interaction_matrix(w.events, w.products), "value")


@query("SELECT user_id, product_id, round(value, 6) AS value FROM impos")
def interaction_matrix_positive(w: Workspace) -> DataFrame:
    return rounded(interactions.interaction_matrix(w.events, w.products, positive_only=True), "value")


@query("SELECT product_id, round(total, 6) AS total FROM m_pop")
def item_popularity(w: Workspace) -> DataFrame:
    return rounded(interactions.item_popularity(w.models.cells), "total")


@query("SELECT product_id, round(total / sum(total) OVER (), 6) AS share FROM m_pop")
def popularity_share(w: Workspace) -> DataFrame:
    return rounded(interactions.popularity_share(w.models.cells), "share")


@query("SELECT DISTINCT user_id, product_id FROM im")
def seen_items(w: Workspace) -> DataFrame:
    return interactions.seen_items(w.models.cells)


@query("SELECT user_id, product_id, round(value, 6) AS value, nth::INT AS nth FROM m_window")
def profile_window(w: Workspace) -> DataFrame:
    return rounded(interactions.profile_window(w.models.cells), "value")


@query("SELECT user_id, product_id, round(CASE WHEN max(value) OVER u - min(value) OVER u > 1e-12 THEN (value - min(value) OVER u) / (max(value) OVER u - min(value) OVER u) ELSE 0 END, 6) AS value FROM im WINDOW u AS (PARTITION BY user_id)")
def minmax_per_user(w: Workspace) -> DataFrame:
    return rounded(interactions.minmax_per_user(w.models.cells, "value"), "value")


# Text and features


@query("SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS cleaned FROM documents", name="clean_text")
def cleaned_text(w: Workspace) -> DataFrame:
    return read(w.spark, w.sf_dir, "documents").select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query("SELECT product_id, text FROM itext", name="item_text")
def item_texts(w: Workspace) -> DataFrame:
    return w.products.select("product_id", item_text().alias("text"))


@query("SELECT product_id, term, n::BIGINT AS n FROM wterm")
def word_ngrams(w: Workspace) -> DataFrame:
    return features.word_terms(w.products)


@query("SELECT product_id, term, n::BIGINT AS n FROM cterm")
def char_ngrams(w: Workspace) -> DataFrame:
    return features.char_terms(w.products)


@query("SELECT product_id, term, round(value, 6) AS value FROM wtfidf")
def tfidf_word(w: Workspace) -> DataFrame:
    return rounded(features.tfidf(features.word_terms(w.products), w.products, features.WORD_MIN_DF), "value")


@query("SELECT product_id, term, round(value, 6) AS value FROM ctfidf")
def tfidf_char(w: Workspace) -> DataFrame:
    return rounded(features.tfidf(features.char_terms(w.products), w.products, features.CHAR_MIN_DF), "value")


@query("SELECT product_id, round(log_price, 6) AS log_price, rating, round(log_rating_count, 6) AS log_rating_count FROM num")
def numeric_features(w: Workspace) -> DataFrame:
    return rounded(features.numeric_features(w.products), "log_price", "log_rating_count")


@query("SELECT product_id, feature, value FROM tax")
def taxonomy_onehot(w: Workspace) -> DataFrame:
    return features.taxonomy_onehot(w.products)


@query("SELECT product_id, feature, round(value, 6) AS value FROM snum")
def scaled_numeric(w: Workspace) -> DataFrame:
    return rounded(features.scaled_numeric(w.products), "value")


@query("SELECT product_id, feature, round(value, 6) AS value FROM feat")
def item_features(w: Workspace) -> DataFrame:
    return rounded(w.features, "value")


@query("SELECT vec_id, dim::INT AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS value FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS dim FROM embeddings)")
def l2_normalize(w: Workspace) -> DataFrame:
    long = read(w.spark, w.sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))
    return rounded(features.l2_normalize(long, "vec_id"), "value")


@query("""SELECT query_id, vec_id, round(cosine, 6) AS cosine, rank::INT AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS cosine,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY round(cosine, 9) DESC, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 10""")
def embedding_topk(w: Workspace) -> DataFrame:
    return rounded(features.embedding_topk(read(w.spark, w.sf_dir, "embeddings"), 10), "cosine")


@query("SELECT product_id, round(quality, 6) AS quality FROM quality")
def quality_prior(w: Workspace) -> DataFrame:
    return rounded(content.quality_prior(w.products), "quality")


# Popularity and neighbours


def _ranked(table: str, k: int = 10) -> str:
    return f"SELECT user_id, product_id, round(score, 6) AS score, rank::INT AS rank FROM {table} WHERE rank <= {k}"


@query(_ranked("m_poprecs"))
def popularity_recs(w: Workspace) -> DataFrame:
    return rounded(w.models.recommend("popularity", 10), "score")


@query("SELECT product_id, round(score, 6) AS score, (row_number() OVER (ORDER BY round(score, 9) DESC, product_id))::INT AS rank FROM m_popscore QUALIFY rank <= 10")
def trending(w: Workspace) -> DataFrame:
    return rounded(popularity.trending(w.models.cells, w.products), "score")


@query("SELECT i, j, round(dot, 6) AS dot FROM m_co WHERE i <= j")
def item_cooccurrence(w: Workspace) -> DataFrame:
    return rounded(knn.cooccurrence(w.models.cells), "dot")


@query("SELECT i, j, round(sim, 6) AS sim FROM m_sim")
def item_similarity(w: Workspace) -> DataFrame:
    return rounded(knn.similarity(w.models.cells), "sim")


@query("SELECT i, j, round(sim, 6) AS sim, rank::INT AS rank FROM m_near")
def knn_neighbours(w: Workspace) -> DataFrame:
    return rounded(w.models.near, "sim")


@query("SELECT user_id, product_id, round(score, 6) AS score FROM m_kraw")
def knn_scores(w: Workspace) -> DataFrame:
    return rounded(knn.scores(w.models.cells, w.models.near), "score")


@query(_ranked("m_krecs"))
def knn_recs(w: Workspace) -> DataFrame:
    return rounded(w.models.recommend("collaborative", 10), "score")


def _similar_knn(k: int) -> str:
    return f"SELECT p.product_id, coalesce(sim, 0) AS score, row_number() OVER (ORDER BY round(coalesce(sim, 0), 9) DESC, p.product_id) AS rank FROM prod p LEFT JOIN (SELECT i, sim FROM m_near WHERE j = '{ITEM}') n ON p.product_id = n.i WHERE p.product_id <> '{ITEM}' QUALIFY rank <= {k}"


def _similar_content(k: int) -> str:
    return f"SELECT a.product_id, sum(a.value * b.value) AS score, row_number() OVER (ORDER BY round(sum(a.value * b.value), 9) DESC, a.product_id) AS rank FROM feat a JOIN feat b USING (feature) WHERE b.product_id = '{ITEM}' AND a.product_id <> '{ITEM}' GROUP BY a.product_id QUALIFY rank <= {k}"


@query(f"SELECT product_id, round(score, 6) AS score, rank::INT AS rank FROM ({_similar_knn(10)})")
def similar_collab(w: Workspace) -> DataFrame:
    return rounded(knn.similar(w.models.near, w.products, ITEM), "score").drop("user_id")


@query("SELECT user_id, product_id, round(value, 6) AS score, (row_number() OVER (PARTITION BY user_id ORDER BY round(value, 9) DESC, product_id))::INT AS rank FROM im JOIN prod USING (product_id) WHERE category <> 'ECONOMY' QUALIFY rank <= 3", name="rank_topk")
def rank_best(w: Workspace) -> DataFrame:
    """Cells as scores, one category left out by candidates."""
    some = w.products.where("category != 'ECONOMY'")
    return rounded(rank_topk(w.models.cells.withColumnRenamed("value", "score"), 3, candidates=some), "score")


# Content


@query("SELECT user_id, feature, round(value, 6) AS value FROM m_prof")
def content_profile(w: Workspace) -> DataFrame:
    return rounded(content.content_profile(w.models.cells, w.features), "value")


@query("SELECT user_id, product_id, round(score, 6) AS score FROM m_cmean")
def content_mean_scores(w: Workspace) -> DataFrame:
    return rounded(content.mean_scores(w.models.cells, w.packs), "score")


@query("SELECT user_id, product_id, round(score, 6) AS score FROM m_cmax")
def content_max_scores(w: Workspace) -> DataFrame:
    return rounded(content.max_scores(w.models.cells, w.packs), "score")


@query(_ranked("m_crecs"))
def content_recs(w: Workspace) -> DataFrame:
    return rounded(w.models.recommend("content", 10), "score")


@query(f"SELECT product_id, round(score, 6) AS score, rank::INT AS rank FROM ({_similar_content(10)})")
def similar_content(w: Workspace) -> DataFrame:
    return rounded(content.similar(w.features, ITEM), "score").drop("user_id")


# Latent factors and fusions


def _factors(w: Workspace) -> DataFrame:
    return w.keep(latent.item_factors(w.models.cells, w.products))


@query()
def svd_scores(w: Workspace) -> DataFrame:
    return rounded(latent.scores(w.models.cells, _factors(w)), "score")


@query("SELECT product_id, round(x, 6) AS x FROM o_first1")
def svd_first_factor(w: Workspace) -> DataFrame:
    """The first factor of all orders (they hardly fade) against the whole catalogue, by passes until its residual is small."""
    cells = w.keep(interactions.interaction_matrix(star_events(w.spark, w.sf_dir), w.products, halflife_days=36500.0))
    return latent.item_factors(cells, w.products, 1).select("product_id", F.round(F.abs(F.get("factors", F.lit(0))), 6).alias("x"))


@query()
def collaborative_recs(w: Workspace) -> DataFrame:
    return rounded(hybrid.recommend_collaborative(w.models.cells, w.products, w.models.near, _factors(w), 10), "score")


@query("SELECT user_id, product_id, round(score, 6) AS score FROM m_lraw")
def svd_scores_2f(w: Workspace) -> DataFrame:
    """svd_scores with two factors, which SQL can find by squaring."""
    return rounded(latent.scores(w.models.cells, w.models.two_factors), "score")


@query("SELECT user_id, product_id, round(score, 6) AS score, rank::INT AS rank FROM m_brecs WHERE n = 0.5 AND rank <= 10")
def collaborative_recs_2f(w: Workspace) -> DataFrame:
    """collaborative_recs with two factors."""
    return rounded(w.models.blends(10).drop("knn_weight"), "score")


def _members(w: Workspace) -> list[tuple[float, DataFrame]]:
    m = w.models
    return [(0.4, m.member("content")), (0.5, m.member("collaborative")), (0.1, m.member("popularity"))]


@query("SELECT user_id, product_id, round(score, 6) AS score FROM fused")
def rrf_fusion(w: Workspace) -> DataFrame:
    return rounded(hybrid.rrf(_members(w)), "score")


@query("SELECT user_id, product_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, product_id))::INT AS rank FROM fused QUALIFY rank <= 10")
def hybrid_rrf_recs(w: Workspace) -> DataFrame:
    return rounded(hybrid.recommend_rrf(_members(w), 10), "score")


def _scaled(table: str, column: str = "score") -> str:
    return f"SELECT user_id, product_id, CASE WHEN max({column}) OVER w - min({column}) OVER w > 1e-12 THEN ({column} - min({column}) OVER w) / (max({column}) OVER w - min({column}) OVER w) ELSE 0 END AS x FROM {table} WINDOW w AS (PARTITION BY user_id)"


@query(f"""SELECT user_id, product_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, product_id))::INT AS rank FROM (
  SELECT user_id, product_id, 0.4 * c.x + 0.5 * k.x + 0.1 * p.x AS score FROM m_grid g JOIN ({_scaled('m_cscore')}) c USING (user_id, product_id) JOIN ({_scaled('m_kscore')}) k USING (user_id, product_id)
  JOIN ({_scaled('(SELECT user_id, product_id, score FROM m_users, m_popscore)')}) p USING (user_id, product_id) WHERE NOT g.seen) QUALIFY rank <= 10""")
def hybrid_score_recs(w: Workspace) -> DataFrame:
    m = w.models
    n_items = w.products.select("product_id").distinct().agg(F.count("*").alias("n"))
    near = knn.scaled_scores(knn.scores(m.cells, m.near), n_items)
    return rounded(content.blended(m.cells, w.products, w.packs, near, popularity.popularity_scores(m.cells, w.products), 10, (0.4, 0.5, 0.1)), "score")


@query(f"""SELECT user_id, product_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, product_id))::INT AS rank FROM (
  SELECT user_id, product_id, 0.4 * c.x + 0.5 * k.x + 0.1 * p.x AS score FROM m_grid g JOIN ({_scaled('m_cscore')}) c USING (user_id, product_id)
  JOIN ({_scaled('(SELECT user_id, product_id, 0.5 * score + 0.5 * latent AS score FROM m_kscore JOIN m_lscore USING (user_id, product_id))')}) k USING (user_id, product_id)
  JOIN ({_scaled('(SELECT user_id, product_id, score FROM m_users, m_popscore)')}) p USING (user_id, product_id) WHERE NOT g.seen) QUALIFY rank <= 10""")
def hybrid_scored_2f(w: Workspace) -> DataFrame:
    """The full hybrid by scores, with two latent factors, without a table of users times items."""
    m = w.models
    return rounded(hybrid.recommend_hybrid(m.cells, w.products, m.near, m.two_factors, w.packs, 10), "score")


@query(f"""SELECT product_id, round(score, 6) AS score, (row_number() OVER (ORDER BY round(score, 9) DESC, product_id))::INT AS rank FROM (
  SELECT product_id, sum(w / (60 + rank)) AS score FROM (SELECT 0.4 AS w, product_id, rank FROM ({_similar_content(20)}) UNION ALL SELECT 0.5, product_id, rank FROM ({_similar_knn(20)})) GROUP BY product_id) QUALIFY rank <= 10""")
def similar_hybrid(w: Workspace) -> DataFrame:
    return rounded(hybrid.similar(w.features, w.models.near, w.products, ITEM), "score").drop("user_id")


@query("""SELECT user_id, product_id, title, price, round(score, 6) AS score, (row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, product_id))::INT AS rank
  FROM m_kscore JOIN prod USING (product_id) WHERE NOT seen AND category = 'ECONOMY' AND price <= 1500 QUALIFY rank <= 10""")
def serve_filtered(w: Workspace) -> DataFrame:
    some = catalog.CatalogFilters(category="ECONOMY", max_price=1500).apply(w.products)
    ranked = knn.recommend(w.models.cells, w.products, w.models.near, 10, candidates=some)
    return catalog.hydrate(ranked, w.products, w.models.cells).select("user_id", "product_id", "title", "price", "score", "rank")


# Split, metrics, tuning


def _events(df: DataFrame) -> DataFrame:
    return micros(df).select(*EVENT)


@query("SELECT event_id, user_id, product_id, event_type, us FROM s_train")
def split_train(w: Workspace) -> DataFrame:
    return _events(w.split.train)


@query("SELECT event_id, user_id, product_id, event_type, us FROM s_val")
def split_val(w: Workspace) -> DataFrame:
    return _events(w.split.val)


@query("SELECT event_id, user_id, product_id, event_type, us FROM s_test")
def split_test(w: Workspace) -> DataFrame:
    return _events(w.split.test)


@query("SELECT DISTINCT user_id, product_id FROM s_test")
def ground_truth(w: Workspace) -> DataFrame:
    return w.split.truth("test")


@query("SELECT segment, user_id FROM s_seg")
def user_segments(w: Workspace) -> DataFrame:
    return segments(w.split.train_counts)


_METRICS = ["precision", "recall", "map", "ndcg", "mrr", "hit_rate"]


@query("SELECT user_id, k, " + ", ".join(f'round("{c}", 6) AS "{c}"' for c in _METRICS) + " FROM kuser")
def metrics_at_k(w: Workspace) -> DataFrame:
    return rounded(metrics.metrics_at_k(w.split_models.recommend("collaborative", 20), w.split.truth(), KS), *_METRICS)


@query("SELECT model, segment, k, count(*)::BIGINT AS n_users, " + ", ".join(f'round(avg("{c}"), 6) AS "{c}"' for c in _METRICS) + " FROM (SELECT 'collaborative' AS model, * FROM kuser UNION ALL SELECT 'popularity', * FROM puser) u JOIN s_seg USING (user_id) GROUP BY ALL")
def eval_summary(w: Workspace) -> DataFrame:
    recs = evaluate.of_models({name: w.split_models.recommend(name, 20) for name in ("collaborative", "popularity")})
    return rounded(evaluate.summarise(recs, w.split.truth(), segments(w.split.train_counts), KS), *_METRICS)


@query("SELECT k, round(count(DISTINCT product_id) / (SELECT count(*) FROM prod), 6) AS coverage FROM krecs20 JOIN (SELECT unnest([5, 10, 20]) AS k) ON rank <= k GROUP BY k")
def catalog_coverage(w: Workspace) -> DataFrame:
    return rounded(metrics.catalog_coverage(w.split_models.recommend("collaborative", 20), w.products, KS), "coverage")


@query("SELECT user_id, k, round(avg(-log2(greatest(coalesce(total / (SELECT sum(total) FROM sm_pop), 0), 1e-12))), 6) AS novelty FROM krecs20 JOIN (SELECT unnest([5, 10, 20]) AS k) ON rank <= k LEFT JOIN sm_pop USING (product_id) GROUP BY ALL")
def novelty(w: Workspace) -> DataFrame:
    shares = interactions.popularity_share(w.split_models.cells)
    return rounded(metrics.novelty(w.split_models.recommend("collaborative", 20), shares, w.products, KS), "novelty")


_CHOSEN = """SELECT k, nth, items FROM (SELECT k, user_id, list(product_id) AS items, row_number() OVER (PARTITION BY k ORDER BY user_id) AS nth, count(*) OVER (PARTITION BY k) AS n_lists
  FROM krecs20 JOIN (SELECT unnest([5, 10, 20]) AS k) ON rank <= k GROUP BY k, user_id HAVING count(*) > 1) WHERE (nth - 1) % greatest(1, n_lists // 200) = 0 AND (nth - 1) // greatest(1, n_lists // 200) < 200"""


@query(f"""SELECT k, round(1 - avg(len(list_intersect(x.items, y.items)) / len(list_distinct(list_concat(x.items, y.items)))), 6) AS personalisation
  FROM ({_CHOSEN}) x JOIN ({_CHOSEN}) y USING (k) WHERE x.nth < y.nth GROUP BY k""")
def personalisation(w: Workspace) -> DataFrame:
    return rounded(metrics.personalisation(w.split_models.recommend("collaborative", 20), KS), "personalisation")


@query("""SELECT user_id, round(CASE WHEN count(*) < 2 THEN 0 ELSE 1 - coalesce(max(total), 0) / (count(*) * (count(*) - 1)) END, 6) AS diversity, 10 AS k FROM m_krecs LEFT JOIN (
    SELECT a.user_id, sum(cos) AS total FROM m_krecs a JOIN m_krecs b ON a.user_id = b.user_id AND a.rank <> b.rank JOIN (
      SELECT x.product_id AS i, y.product_id AS j, sum(x.value * y.value) AS cos FROM feat x JOIN feat y USING (feature)
      WHERE x.product_id IN (SELECT product_id FROM m_krecs WHERE rank <= 10) AND y.product_id IN (SELECT product_id FROM m_krecs WHERE rank <= 10) GROUP BY ALL) c ON c.i = a.product_id AND c.j = b.product_id
    WHERE a.rank <= 10 AND b.rank <= 10 GROUP BY a.user_id) USING (user_id) WHERE rank <= 10 GROUP BY user_id""")
def diversity(w: Workspace) -> DataFrame:
    recs = w.models.recommend("collaborative", 10)
    shown = recs.select("product_id").distinct()
    # The whole catalogue teaches the weights of features, only what is in a list is described.
    described = features.FittedFeatures.fit(w.products).transform(w.products.join(shown, "product_id", "left_semi"))
    cosines = features.item_cosine(w.keep(described))
    return rounded(metrics.diversity(recs, cosines, [10]), "diversity")


_SCORED = """SELECT trial, avg(ndcg + 0.05 * coverage) AS objective, max(ndcg) FILTER (segment = 'all') AS ndcg, max(coverage) FILTER (segment = 'all') AS coverage FROM (
    SELECT trial, segment, avg(ndcg) AS ndcg FROM (SELECT split_part(user_id, '#', 1) AS user_id, split_part(user_id, '#', 2)::INT AS trial, ndcg FROM tuser) JOIN t_seg USING (user_id) WHERE segment <> 'warm' GROUP BY ALL)
  JOIN (SELECT trial, segment, count(DISTINCT product_id) / (SELECT count(*) FROM prod) AS coverage FROM trecs r JOIN t_seg s ON r.person = s.user_id WHERE segment <> 'warm' GROUP BY ALL) USING (trial, segment) GROUP BY trial"""


@query(f"SELECT trial::INT AS trial, c AS content_weight, k AS collab_weight, round(objective, 6) AS objective, round(ndcg, 6) AS ndcg, round(coverage, 6) AS coverage FROM ({_SCORED}) JOIN trials USING (trial)")
def tuning_grid(w: Workspace) -> DataFrame:
    return rounded(w.trial_scores.select("trial", "content_weight", "collab_weight", "objective", "ndcg", "coverage"), "objective", "ndcg", "coverage")


@query(f"SELECT trial::INT AS trial, round(objective, 6) AS objective FROM ({_SCORED})")
def tuning_objective(w: Workspace) -> DataFrame:
    return rounded(w.trial_scores.select("trial", "objective"), "objective")


@query(f"SELECT trial::INT AS trial, c AS content_weight, k AS collab_weight, n AS knn_weight, round(objective, 6) AS objective, round(ndcg, 6) AS ndcg, round(coverage, 6) AS coverage FROM ({_SCORED.replace('tuser', 't3user').replace('trecs', 't3recs')}) JOIN trials3 USING (trial)")
def tuning_grid_full(w: Workspace) -> DataFrame:
    """All 63 trials; the collaborative member with two latent factors."""
    columns = ["objective", "ndcg", "coverage"]
    return rounded(w.full_trial_scores.select("trial", "content_weight", "collab_weight", "knn_weight", *columns), *columns)


@query("SELECT split_part(u.user_id, '#', 1) AS model, segment, k, count(*)::BIGINT AS n_users, " + ", ".join(f'round(avg("{c}"), 6) AS "{c}"' for c in _METRICS) + " FROM evuser u JOIN t_seg s ON split_part(u.user_id, '#', 2) = s.user_id GROUP BY ALL")
def eval_models(w: Workspace) -> DataFrame:
    """Four models over the split of visitors' events; the collaborative one, and the hybrid's member, with two latent factors."""
    s = w.tuning_split
    return rounded(evaluate.summarise(evaluate.of_models(w.four_models), s.truth(), segments(s.train_counts), KS), *_METRICS)


_EV = """(SELECT split_part(r.user_id, '#', 1) AS model, s.user_id, segment, k, product_id, rank FROM evrecs r JOIN t_seg s ON split_part(r.user_id, '#', 2) = s.user_id
    JOIN (SELECT unnest([5, 10, 20]) AS k) ON rank <= k WHERE s.user_id IN (SELECT user_id FROM t_test))"""
_EV_CHOSEN = f"""(SELECT model, segment, k, nth, items FROM (SELECT model, segment, k, user_id, list(product_id) AS items, row_number() OVER (PARTITION BY model, segment, k ORDER BY user_id) AS nth, count(*) OVER (PARTITION BY model, segment, k) AS n_lists
  FROM {_EV} GROUP BY model, segment, k, user_id HAVING count(*) > 1) WHERE (nth - 1) % greatest(1, n_lists // 200) = 0 AND (nth - 1) // greatest(1, n_lists // 200) < 200)"""
_EV_COS = "(SELECT x.product_id AS i, y.product_id AS j, sum(x.value * y.value) AS cos FROM feat x JOIN feat y USING (feature) WHERE x.product_id IN (SELECT product_id FROM evrecs) AND y.product_id IN (SELECT product_id FROM evrecs) GROUP BY ALL)"


@query(f"""SELECT model, segment, k, coverage, novelty, coalesce(personalisation, 0) AS personalisation, diversity FROM
  (SELECT model, segment, k, round(count(DISTINCT product_id) / (SELECT count(*) FROM prod), 5) AS coverage FROM {_EV} GROUP BY ALL)
  JOIN (SELECT model, segment, k, round(avg(n), 5) AS novelty FROM (SELECT model, segment, k, user_id, avg(-log2(greatest(coalesce(total / (SELECT sum(total) FROM tm_pop), 0), 1e-12))) AS n FROM {_EV} e LEFT JOIN tm_pop USING (product_id) GROUP BY ALL) GROUP BY ALL) USING (model, segment, k)
  LEFT JOIN (SELECT model, segment, k, round(coalesce(1 - avg(len(list_intersect(x.items, y.items)) / len(list_distinct(list_concat(x.items, y.items)))), 0), 5) AS personalisation FROM {_EV_CHOSEN} x JOIN {_EV_CHOSEN} y USING (model, segment, k) WHERE x.nth < y.nth GROUP BY ALL) USING (model, segment, k)
  JOIN (SELECT model, segment, k, round(avg(CASE WHEN n < 2 THEN 0 ELSE 1 - coalesce(total, 0) / (n * (n - 1)) END), 5) AS diversity FROM
    (SELECT model, segment, k, user_id, count(*) AS n FROM {_EV} GROUP BY ALL) LEFT JOIN
    (SELECT a.model, a.segment, a.k, a.user_id, sum(cos) AS total FROM {_EV} a JOIN {_EV} b ON a.model = b.model AND a.segment = b.segment AND a.k = b.k AND a.user_id = b.user_id AND a.rank <> b.rank JOIN {_EV_COS} c ON c.i = a.product_id AND c.j = b.product_id GROUP BY ALL)
    USING (model, segment, k, user_id) GROUP BY ALL) USING (model, segment, k)""")
def eval_beyond_accuracy(w: Workspace) -> DataFrame:
    """What the full report says of the same four models besides accuracy: three segments, three prefixes."""
    m, s = w.tuning_models, w.tuning_split
    shown = features.packed(w.features.join(evaluate.of_models(w.four_models).select("product_id").distinct(), "product_id", "left_semi"))
    cosines = w.keep(features.cosines(shown, shown))
    report = evaluate.evaluate(w.four_models, s.truth(), segments(s.train_counts), w.products, interactions.popularity_share(m.cells), KS, cosines)
    return report.select("model", "segment", "k", "coverage", "novelty", "personalisation", "diversity")


@query()
def live_profile_batch(w: Workspace) -> DataFrame:
    """Profiles of everyone after all that they did, folded event by event from nothing."""
    known = w.events.where("event_type in ('wishlist', 'add_to_cart', 'purchase', 'rating')").withColumn("weight", event_weight(F.col("event_type"), F.col("weight")))
    start = w.spark.createDataFrame([], "user_id string, feature string, value double")
    return rounded(content.fold_event(start, w.features, known), "value")
