"""Benchmark passages in documents, by a prefix-filtered join of word shingles.

Everything is DataFrame operations. Benchmark windows are sequences of shingles (three
words, fewer for items that are shorter). One scan joins the documents' shingle hashes with
the benchmark's: what survives tells how often each shingle stands in the corpus, and so
the order by rarity. A window can only occur where its rarest shingle does, so that prefix
proposes (document, item, offset) and the windows' length and position bounds apply to it;
then the item's shingles are laid out from a proposed offset on and joined with the document's at the same places: a run
of them as long as the window agrees in every consecutive shingle hash, and the words of the few documents with
such runs are compared with the item's one by one, so that no occurrence rests on hashes.

The survivors are a few bytes each. The benchmark's shingles are broadcast up to a checked count, a
larger benchmark in several parts of that size with a scan for each, and beyond MAX_PARTS by shuffling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, documents_of, fresh, stored

WINDOW = 13
SHINGLE = 3
#: Rows of two longs each, some 50 MB as a hash table, which every executor can hold.
BROADCAST_ROWS = 1_000_000
MAX_PARTS = 8
#: A document is contaminated when so many times its hit words reach its words.
MIN_SHARE_OF_WORDS = 20


def words_of(text: Column) -> Column:
    """Lower-cased words of a whole text; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def shingles(words: Column, k: int) -> Column:
    """The hash of every k consecutive words, in order."""
    n = F.size(words)
    at = lambda i, j: F.get(words, i + j)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(at(i, j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, w, copy): the words of each item, and of each further text of the same id."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where(F.col("item_id").isNotNull() & (F.size("w") > 0)).distinct()
    return items.withColumn("copy", F.row_number().over(Window.partitionBy("item_id").orderBy("w")))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per shingle of each item: item_id, k (its words), need (a window's shingles), ipos, h.

    Items without words have none; rows that repeat an item_id are one item with all their texts.
    """
    items = _items(benchmark)
    n = F.size("w")
    k = F.least(F.lit(shingle), n)
    need = F.least(F.lit(window), n) - k + 1
    parts = [items.where(k == j).select("item_id", "copy", F.lit(j).alias("k"), need.alias("need"), F.posexplode(shingles(F.col("w"), j)).alias("ipos", "h")) for j in range(1, shingle + 1)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(sizes, runs): doc_id, mark, n_words of every row; and doc_id, mark, item_id, first and
    last hit word of every maximal stretch that windows of an item cover.

    mark is the text's hash, so rows that repeat a doc_id with other texts stay apart.
    """
    bench = stored(benchmark_windows(benchmark, window, shingle), "benchmark-shingles")
    own = documents_of(docs).select("doc_id", F.xxhash64("text").alias("mark"), words_of(F.col("text")).alias("w"))
    wanted = bench.select("k", "h").distinct()
    sizes_k = [r.k for r in wanted.select("k").distinct().orderBy("k").collect()]  # at most one for each shingle length
    if not sizes_k:
        none = docs.sparkSession.createDataFrame([], "doc_id long, mark long, item_id string, first int, last int")
        return own.select("doc_id", "mark", F.size("w").cast("long").alias("n_words")), none
    n_parts = -(-wanted.count() // BROADCAST_ROWS) if BROADCAST_ROWS else MAX_PARTS + 1
    if n_parts > MAX_PARTS:
        parts = [wanted]
    else:
        parts = [F.broadcast(wanted.where(F.pmod("h", F.lit(n_parts)) == p)) for p in range(n_parts)]
    # A document with no words still gives a row, by the outer explode, and with it its size.
    hashed = own.select("doc_id", "mark", F.size("w").alias("n_words"), *(shingles(F.col("w"), k).alias(f"s{k}") for k in sizes_k))
    found = None
    for k in sizes_k:
        rows = hashed.select("doc_id", "mark", "n_words", F.lit(k).alias("k"), F.posexplode_outer(f"s{k}").alias("pos", "h"))
        for p, part in enumerate(parts):
            marked = rows.join(part.withColumn("known", F.lit(True)), ["k", "h"], "left").withColumn("part", F.lit(p))
            marked = marked.where("known or part = 0 and coalesce(pos, 0) = 0")
            found = marked if found is None else found.unionByName(marked)
    survivors = stored(found.select("doc_id", "mark", "n_words", "k", "pos", "h", "known", "part"), "survivors")
    sizes = survivors.where((F.col("k") == sizes_k[0]) & (F.col("part") == 0) & (F.coalesce("pos", F.lit(0)) == 0)).select("doc_id", "mark", F.col("n_words").cast("long").alias("n_words"))
    hits = survivors.where("known").drop("known", "part").distinct()

    rarity = hits.groupBy("k", "h").agg(F.count("*").alias("n"))
    ranked = bench.join(rarity, ["k", "h"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # A window's rarest shingle: the smallest of the need shingles from its start.
    ahead = Window.partitionBy("item_id", "copy").orderBy("ipos").rowsBetween(0, window - 1)
    order = F.struct(F.col("n"), F.col("h"), F.col("ipos"))
    best = F.array_min(F.slice(F.collect_list(order).over(ahead), F.lit(1), F.col("need")))
    length = F.count("*").over(Window.partitionBy("item_id", "copy"))
    prefix = ranked.select("item_id", "copy", "k", "need", "ipos", best.alias("rarest"), length.alias("total")).where(F.col("ipos") + F.col("need") <= F.col("total"))
    prefix = stored(prefix.where("rarest.n > 0").select("item_id", "copy", "k", "need", F.col("ipos").alias("start"), F.col("rarest.h").alias("h"), F.col("rarest.ipos").alias("at")).distinct(), "prefixes")

    # Offset: where the item's first shingle would stand. The window has to lie within the document.
    proposed = hits.join(prefix, ["k", "h"]).withColumn("offset", F.col("pos") - F.col("at"))
    begin = F.col("offset") + F.col("start")
    bounded = proposed.where((begin >= 0) & (begin + F.col("need") + F.col("k") - 1 <= F.col("n_words")))
    offsets = bounded.select("doc_id", "mark", "item_id", "copy", "offset").distinct()
    # Every shingle of a proposed item, where it would stand; the document's own at that place has to be the same.
    laid = offsets.join(bench.select("item_id", "copy", "k", "need", "ipos", "h"), ["item_id", "copy"]).withColumn("pos", F.col("offset") + F.col("ipos")).where("pos >= 0")
    verified = laid.join(hits, [laid.doc_id.eqNullSafe(hits.doc_id), *(laid[c] == hits[c] for c in ("mark", "k", "pos", "h"))], "left_semi")
    line = Window.partitionBy("doc_id", "mark", "item_id", "copy", "offset").orderBy("pos")
    runs = verified.withColumn("run", F.col("pos") - F.row_number().over(line)).groupBy("doc_id", "mark", "item_id", "copy", "offset", "run")
    spans = runs.agg(F.min("pos").alias("first"), (F.max("pos") + F.max("k") - 1).alias("last"), F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need")
    return sizes, _verified(docs, benchmark, stored(spans.select("doc_id", "mark", "item_id", "copy", "offset", "first", "last"), "spans"), window)


def _verified(docs: DataFrame, benchmark: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """spans cut to the stretches whose words are the item's, where these are as long as a window."""
    items = _items(benchmark).select("item_id", "copy", F.col("w").alias("iw"))
    held = spans.select(F.col("doc_id").alias("s_id"), F.col("mark").alias("s_mark")).distinct()
    own = documents_of(docs).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    # Only documents with a span: their keys are stored, so they are sent to the scan where they are few.
    met = own.join(stored(held, "span-documents"), own.doc_id.eqNullSafe(F.col("s_id")) & (own.mark == F.col("s_mark")), "left_semi").distinct()
    words = met.select(F.col("doc_id").alias("s_id"), F.col("mark").alias("s_mark"), words_of(F.col("text")).alias("w"))
    both = spans.join(words, spans.doc_id.eqNullSafe(F.col("s_id")) & (spans.mark == F.col("s_mark"))).join(items, ["item_id", "copy"])
    other = F.filter(F.sequence("first", "last"), lambda p: ~F.get(F.col("w"), p).eqNullSafe(F.get(F.col("iw"), p - F.col("offset"))))
    bounds = F.concat(F.array(F.col("first") - 1), other, F.array(F.col("last") + 1))
    least = F.least(F.lit(window), F.size("iw"))
    cut = both.select("doc_id", "mark", "item_id", least.alias("least"), F.explode(F.arrays_zip(F.slice(bounds, 1, F.size(bounds) - 1).alias("a"), F.slice(bounds, 2, F.size(bounds) - 1).alias("b"))).alias("z"))
    return cut.select("doc_id", "mark", "item_id", (F.col("z.a") + 1).alias("first"), (F.col("z.b") - 1).alias("last"), "least").where("last - first + 1 >= least").drop("least")


def _judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = MIN_SHARE_OF_WORDS) -> DataFrame:
    """contamination() with each row's mark."""
    sizes, runs = occurrences(docs, benchmark, window, shingle)
    runs = stored(runs, "runs")
    line = Window.partitionBy("doc_id", "mark").orderBy("first", "last")
    before = F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, F.coalesce(before, F.lit(-1))))
    hit = runs.withColumn("new", new).groupBy("doc_id", "mark").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    hit = hit.select(F.col("doc_id").alias("h_id"), F.col("mark").alias("h_mark"), "n_hit", "items")
    met = sizes.join(hit, sizes.doc_id.eqNullSafe(hit.h_id) & (sizes.mark == hit.h_mark), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return met.select(
        "doc_id", "mark", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = MIN_SHARE_OF_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts each word once however many windows cover it. Null and empty texts, and
    tables without items, give zeros and the hash of the empty string. Null item ids are
    left out. Repeated rows are each returned.
    """
    return _judged(docs, benchmark, window, shingle, share).drop("mark")


def clean_rows(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without contaminated rows, each judged by itself whether its doc_id is null or repeated; all columns stay."""
    i, m = fresh(docs, "__gone", "__mark")
    gone = _judged(docs, benchmark, **options).where("contaminated").select(F.col("doc_id").alias(i), F.col("mark").alias(m)).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(docs["text"].cast("string")) == F.col(m))
    return docs.join(gone, same, "left_anti")
