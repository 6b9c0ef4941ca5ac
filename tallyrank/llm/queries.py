"""The opN_ queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, importance, license_scan, line_dedup, pivot_search, quality, sentencepiece_codec, simhash, token_alignment, token_packing, toxicity, url_filter
from .bpe import Encoder
from .common import scratch, table
from .token_counts import TokenRollup, count_changes


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as one batch of inserts, delivered twice."""
    rollup = TokenRollup(spark, scratch(spark, "token-rollup"))
    changes = count_changes(table(spark, sf_dir, "documents"), Encoder(spark))
    for _ in range(2):
        rollup.apply("documents", changes)
    return rollup.totals()


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.keep_summary(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256", "keep_runs")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' verdicts are the labels that the tree learns from: no table labels pages."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5_url_filters that SQL can say; verdict is empty where no rule fits."""
    found = op5_url_filters(spark, sf_dir)
    return found.select("page_id", "host", "path", F.coalesce("rule", F.lit("")).alias("rule"), F.when(F.col("rule").isNotNull(), F.col("verdict")).otherwise("").alias("ruled"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_quality_rules that SQL can say: counts and base rules."""
    return op3_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def token_rollup_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, the first delivered twice and the ledger compacted after it: all documents; those with blanks at an
    end revised to the text without; and every copy of an earlier document's text deleted. Documents and characters left."""
    rollup, encoder = TokenRollup(spark, scratch(spark, "token-rollup")), Encoder(spark)
    docs = table(spark, sf_dir, "documents")
    every = count_changes(docs, encoder)
    for _ in range(2):
        rollup.apply("documents", every)
    rollup.compact()
    trimmed = F.trim(F.coalesce("text", F.lit("")))
    rollup.apply("trimmed", count_changes(docs.where(trimmed != F.col("text")).withColumn("text", trimmed), encoder, "revise"))
    first = docs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).agg(F.min("doc_id").alias("first"))
    copies = docs.withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256)).join(first, "h").where("doc_id > first").select(*docs.columns)
    rollup.apply("copies", count_changes(copies, encoder, "delete"))
    return rollup.totals().select("source", "lang", "n_docs", "n_chars")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), sentencepiece_codec.Codec(spark))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("blocks")


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9_license_scan that SQL can say: the phrases. Word numbers are -1 where there is none."""
    none = F.lit(-1).cast("long")
    return op9_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", F.coalesce("first_word", none).alias("first_word"), F.coalesce("last_word", none).alias("last_word"), "base_labels")


def op10_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_packing.pack_documents(table(spark, sf_dir, "documents"), Encoder(spark))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return pivot_search.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op12_importance_resampling for SQL, with rank -1 where a row wasn't drawn."""
    return op12_importance_resampling(spark, sf_dir).withColumn("rank", F.coalesce("rank", F.lit(-1).cast("long")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align(table(spark, sf_dir, "documents"), token_alignment.Tokenizers(spark))
    return found.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))).drop("groups")


_OP4_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id < s.last_doc AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key),
runs AS (
  SELECT doc_id, string_agg((first - 1) || '-' || (last - 1), ',' ORDER BY first) AS keep_runs
  FROM (SELECT doc_id, min(pos) AS first, max(pos) AS last
        FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM marked WHERE NOT gone) GROUP BY doc_id, island)
  GROUP BY doc_id)
SELECT m.doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256, coalesce(any_value(keep_runs), '') AS keep_runs
FROM marked m LEFT JOIN runs r ON m.doc_id = r.doc_id GROUP BY m.doc_id
"""

_OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_LICENSE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
phrases AS (
  SELECT string_split(phrase, ' ') AS p, label
  FROM (VALUES ('under the mit license', 'mit'), ('apache license version 2', 'apache-2'), ('cc by nc', 'cc-by-nc')) t(phrase, label)),
places AS (
  SELECT doc_id, label, i - 1 AS pos
  FROM (SELECT doc_id, w, p, label, unnest(range(1, len(w) - len(p) + 2)) AS i FROM d, phrases WHERE len(w) >= len(p))
  WHERE w[i : i + len(p) - 1] = p),
found AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, coalesce(first_word, -1)::BIGINT AS first_word, coalesce(last_word, -1)::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels
FROM d LEFT JOIN found USING (doc_id)
"""

_URL_SQL = r"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '') AS h, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
rules AS (SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) t(rh, rp, verdict)),
fit AS (
  SELECT page_id, host, path, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh || rp) DESC) AS nth
  FROM (SELECT DISTINCT * FROM p) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, p.host, p.path, coalesce(rule, '') AS rule, coalesce(verdict, '') AS ruled
FROM p LEFT JOIN fit ON p.page_id = fit.page_id AND p.host = fit.host AND p.path = fit.path AND nth = 1
"""

_QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, i, w[i : i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d)
SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
       (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
       len(w) < 50 OR 100 * coalesce(repeats.n, 0) > 50 * len(w) AS base_failed
FROM d JOIN lines ON d.doc_id = lines.doc_id LEFT JOIN repeats ON d.doc_id = repeats.doc_id
"""

_ROLLUP_SQL = """
SELECT source, lang, count(*)::BIGINT AS n_docs, sum(length(trim(coalesce(text, ''), ' ')))::BIGINT AS n_chars
FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY coalesce(text, '')) GROUP BY source, lang
"""

_OP11_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, least(len(q.e), len(v.e)) + 1), lambda i: q.e[i] * v.e[i]))::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

# The checksum's table is made by its rule, and applied to each distinct word's bytes.
_OP12_SQL = r"""
WITH crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark),
occurring AS (SELECT doc_id, unnest(w) AS word FROM d),
dictionary AS (
  SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                               lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM occurring UNION SELECT word FROM b)), crc_table),
s AS (SELECT bucket, count(*) AS s FROM occurring JOIN dictionary USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN dictionary USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM occurring) + 10000 AS big_s, (SELECT count(*) FROM b) + 10000 AS big_t),
gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * big_s) / ((s + 1)::DOUBLE * big_t)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), sums),
weights AS (
  SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_features, coalesce(floor(sum(gain) / nullif(len(any_value(d.w)), 0)), 0)::BIGINT AS weight
  FROM d LEFT JOIN occurring USING (doc_id) LEFT JOIN dictionary USING (word) LEFT JOIN gains USING (bucket) GROUP BY d.doc_id),
scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weights),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, coalesce(CASE WHEN rank <= 10 * n // 100 THEN rank END, -1)::BIGINT AS rank, n_features AS n_words
FROM scored LEFT JOIN ranked USING (doc_id)
"""

_ALL = (
    op1_token_counts,
    op2_simhash_near_dedup,
    op3_quality_rules,
    op4_line_dedup,
    op5_url_filters,
    op6_toxicity,
    op7_benchmark_decontamination,
    op8_sentencepiece,
    op9_license_scan,
    op10_token_packing,
    op11_topk_search,
    op12_importance_resampling,
    op13_token_alignment,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op4_line_dedup": _OP4_SQL, "op7_benchmark_decontamination": _OP7_SQL, "op11_topk_search": _OP11_SQL}
# Beside the thirteen, the columns of some that SQL can say, each from its operator's own rows.
for _f, _sql in ((license_phrases, _LICENSE_SQL), (url_rules, _URL_SQL), (quality_counts, _QUALITY_SQL), (token_rollup_batches, _ROLLUP_SQL), (importance_draw, _OP12_SQL)):
    QUERIES[_f.__name__], ORACLES[_f.__name__] = _f, _sql
