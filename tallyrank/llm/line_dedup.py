"""Lines that many documents share, dropped everywhere but in one document.

Per document each distinct key counts once, as a 128-bit hash. Hashes are first added up
by hash and salt, so a line of a third of all documents is a few rows afterwards; those
partial rows are range-partitioned by hash with a secondary sort by document (last first)
and position, and one pass over each range sees a hash's first occurrence and its total. Text moves
once, when the bitmaps meet the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, documents_of, fresh, stored

MIN_CHARS = 20
MIN_DOCS = 3
SALTS = 32
_WORD = 64


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    """A null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, mark, dropped): per document with a dropped line a sparse bitmap.

    dropped maps i to a 64-bit word whose bit b is set where line 64 * i + b goes; words
    without a dropped line are left out, and so is a document that keeps all its lines.
    mark is the text's hash: rows that repeat a doc_id with other text keep their own map.
    """
    rows = documents_of(docs).where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    # One projection computes the key, so that its parts do not recompute it.
    keyed = rows.select("doc_id", "mark", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    hashed = stored(keyed.select("doc_id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "line-hashes")
    once = hashed.groupBy("doc_id", "h1", "h2").agg(F.min("pos").alias("pos"))
    salted = once.groupBy("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).agg(F.count("*").alias("n"), F.max(F.struct("doc_id", (-F.col("pos")).alias("back"))).alias("top"))
    placed = salted.select("h1", "h2", "n", F.col("top.doc_id").alias("last"), (-F.col("top.back")).alias("pos"))
    ranged = placed.repartitionByRange(F.col("h1"), F.col("h2")).sortWithinPartitions("h1", "h2", F.desc("last"), "pos")
    same = Window.partitionBy("h1", "h2").orderBy(F.desc("last"), "pos")
    total = F.sum("n").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = ranged.select("h1", "h2", "last", total.alias("n"), F.row_number().over(same).alias("nth")).where("nth = 1")
    spread = stored(first.where(F.col("n") >= min_docs).select("h1", "h2", "last"), "shared-lines")
    gone = hashed.join(spread, ["h1", "h2"]).where("doc_id < last").select("doc_id", "mark", "pos").distinct()
    words = gone.groupBy("doc_id", "mark", F.floor(F.col("pos") / _WORD).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {_WORD})")).alias("bits"))
    return words.groupBy("doc_id", "mark").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def _is_dropped(bitmap: Column, pos: Column) -> Column:
    word = F.try_element_at(bitmap, F.floor(pos / _WORD).cast("int"))
    return F.coalesce(F.getbit(word, (pos % _WORD).cast("int")) == 1, F.lit(False))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, name: str = "__dropped") -> DataFrame:
    """docs with its bitmap under the name given (null: all lines stay)."""
    i, m = fresh(docs, "__id", "__mark")
    right = bitmaps.select(F.col("doc_id").alias(i), F.col("mark").alias(m), F.col("dropped").alias(name))
    met = docs.join(right, (docs["doc_id"] == F.col(i)) & (F.xxhash64(docs["text"]) == F.col(m)), "left")
    return met.drop(i, m)


def kept_text(text: Column, bitmap: Column) -> Column:
    rest = F.filter(lines_of(text), lambda x, i: ~_is_dropped(bitmap, i))
    return F.when(bitmap.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(rest, "\n"))


def keep_runs(n_lines: Column, bitmap: Column) -> Column:
    """The keep bitmap run-length encoded: the first and last number of each run of kept lines, as in 0-4,7-7."""
    gone = F.filter(F.sequence(F.lit(0).cast("long"), n_lines - 1), lambda p: _is_dropped(bitmap, p))
    bounds = F.concat(F.array(F.lit(-1).cast("long")), gone, F.array(n_lines))
    runs = F.zip_with(F.slice(bounds, 1, F.size(bounds) - 1), F.slice(bounds, 2, F.size(bounds) - 1), lambda a, b: F.when(b - a > 1, F.concat((a + 1).cast("string"), F.lit("-"), (b - 1).cast("string"))))
    return F.when(bitmap.isNull(), F.concat(F.lit("0-"), (n_lines - 1).cast("string"))).otherwise(F.array_join(F.array_compact(runs), ","))


def keep_summary(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_dropped, kept_sha256, keep_runs (see there).

    A null or empty text is one empty line. A row without doc_id keeps all its lines and
    counts for none. Repeated rows count as one document and are each returned. A text
    whose every line goes leaves the empty text.
    """
    own = documents_of(docs)
    met = with_bitmaps(own, drop_bitmaps(docs, min_chars, min_docs))
    n_lines = F.size(lines_of(F.col("text"))).cast("long")
    n_dropped = F.coalesce(F.aggregate(F.map_values("__dropped"), F.lit(0), lambda n, x: n + F.bit_count(x)), F.lit(0))
    return met.select(
        "doc_id",
        n_lines.alias("n_lines"),
        n_dropped.cast("long").alias("n_dropped"),
        F.sha2(kept_text(F.col("text"), F.col("__dropped")), 256).alias("kept_sha256"),
        keep_runs(n_lines, F.col("__dropped")).alias("keep_runs"),
    )


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the kept text (and its length in n_chars, if docs has that column)."""
    (name,) = fresh(docs, "__dropped")
    met = with_bitmaps(docs, drop_bitmaps(docs, min_chars, min_docs), name)
    out = met.withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(kept_text(F.col("text"), F.col(name))))
    if "n_chars" in docs.columns:
        changed = F.when(F.col(name).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
        out = out.withColumn("n_chars", changed)
    return out.select(*docs.columns)
