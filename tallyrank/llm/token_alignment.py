"""Alignment of two tokenizers' tokens over the same bytes, by joins.

Both tokenizers cut before a space that follows something which is no blank, so a text's
tokens are those of its words, one after the other. Texts are dealt once by a hash and
encoded word by word: each task writes, per block of texts, every distinct word's two id
lists once, and the texts as lists of word numbers. Both lie in buckets of the block, and all
that follows up to the corpus-wide counts joins within them and moves no row.

In a word, tokens are exploded with their places, their lengths added up by a window, and the
two sides joined where they end at the same byte: the cuts. The running number of a cut is its
group. Tokens of a small group meet within it, those of a long one by ranges of bytes, so a text
that never aligns costs rows in proportion to its tokens. Groups and links then go back to texts.

A pair's count is the number of documents that hold it linked: pairs are made distinct within
each text, and counted; each block asks for the counts of its own distinct pairs only.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucketed, documents_of, slices, stored

TOKENIZERS = "/opt/tokenizers"
BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
#: Bytes of text in a block; one longer text is a block of its own.
BLOCK_BYTES = 1 << 24
#: A group of more possible pairs is linked by ranges, of so many bytes.
GROUP_PAIRS = 1024
RANGE = 64

# A cut before a space needs something before it that no tokenizer takes for a blank, and something behind it.
_DOUBT = "\\s\\x00-\\x20\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u2064\\u3000\\ufeff"
_WORD_ENDS = re.compile(f"(?<=[^{_DOUBT}])(?= [\\s\\S])")
_ODD = re.compile(f"[{_DOUBT}] | \\Z")
_made: dict = {}


def words_of(text: str) -> list[str]:
    """The words of space + text, each without its first character, a space."""
    if not _ODD.search(" " + text):
        return text.split(" ")
    return [w[1:] for w in _WORD_ENDS.split(" " + text)]


class Pair:
    """A byte-level vocabulary (A) and a piece model (B), as read by a worker."""

    def __init__(self, a: str, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(x): x for x in plain} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in plain)}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if "▁" in piece.lstrip("▁") and not self.b.is_control(i):
                raise ValueError(f"piece {piece!r} goes on over a space")
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y], np.int32) for y in (self.a_bytes, self.b_bytes))

    def encode(self, words: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of space + word by A and by B, and whether both are the word's bytes."""
        a = [x.ids for x in self.a.encode_batch_fast([f" {w}" for w in words], add_special_tokens=False)]
        b = self.b.encode(words, num_threads=1)
        whole = [f" {w}".encode() for w in words]
        return a, b, [b"".join(map(self.a_bytes.__getitem__, x)) == t == b"".join(map(self.b_bytes.__getitem__, y)) for x, y, t in zip(a, b, whole, strict=True)]


class Tokenizers:
    """Reads both files (under 5 MB) on the driver; each Python worker builds them once."""

    def __init__(self, spark: SparkSession, a: str = BYTE_LEVEL, b: str = PIECES, tokenizers: str = TOKENIZERS):
        self.name = (a, b)
        self.data = spark.sparkContext.broadcast(((Path(tokenizers) / a).read_text(), (Path(tokenizers) / b).read_bytes()))

    def get(self) -> Pair:
        if self.name not in _made:
            _made[self.name] = Pair(*self.data.value)
        return _made[self.name]


_ENCODED = pa.schema(
    [("block", pa.int64()), ("first", pa.int64()), ("text", pa.int64()), ("doc_id", pa.int64()), ("words", pa.list_(pa.int32())), ("word", pa.int64())]
    + [(c, pa.list_(pa.int32())) for c in ("a", "b", "a_sizes", "b_sizes")]
)
_ENCODED_SQL = "block long, first long, text long, doc_id long, words array<int>, word long, a array<int>, b array<int>, a_sizes array<int>, b_sizes array<int>"
#: A word and a text of a block.
WORD = ["block", "word"]
TEXT = ["block", "text"]


class _Block:
    """Texts until they are enough, and their distinct words; named by the hash of the first, by which it is dealt.

    Several blocks of a task may share a name, so words and texts are numbered from the block's place in its task on.
    """

    def __init__(self, name: int, nth: int):
        self.name, self.first, self.size, self.texts = name, nth << 32, 0, []
        self.words: dict[str, int] = defaultdict()
        self.words.default_factory = self.words.__len__

    def add(self, doc_id: int | None, text: str) -> None:
        self.texts.append((doc_id, np.fromiter(map(self.words.__getitem__, words_of(text)), np.int32)))
        self.size += len(text)

    def batches(self, pair: Pair) -> Iterator[pa.RecordBatch]:
        words, bad = list(self.words), np.zeros(len(self.words), bool)
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            a, b, good = pair.encode(some)
            bad[at : at + len(some)] = ~np.array(good)
            sized = [pa.array([s[np.array(x, np.int64)] for x in y], pa.list_(pa.int32())) for s, y in ((pair.a_sizes, a), (pair.b_sizes, b))]
            yield self._batch(len(some), word=np.arange(at, at + len(some)) + self.first, a=a, b=b, a_sizes=sized[0], b_sizes=sized[1])
        for at in range(0, len(self.texts), 200):
            some = self.texts[at : at + 200]
            # A text with a word that is not its tokens' bytes has no tokens at all.
            yield self._batch(len(some), text=np.arange(at, at + len(some)) + self.first, doc_id=[d for d, _ in some], words=[w[:0] if bad[w].any() else w for _, w in some])

    def _batch(self, n: int, **columns) -> pa.RecordBatch:
        columns |= {"block": np.full(n, self.name, np.int64), "first": np.full(n, self.first, np.int64)}
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ENCODED], schema=_ENCODED)


def encoded(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """Rows of words (block, word, a, b, a_sizes, b_sizes) and of texts (block, first, text, doc_id, words), in buckets of block.

    A text's words are places from the block's first on.

    docs (doc_id, text) holds no null or empty text.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("block")).repartition(n, "block")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, nth = None, 0
        for batch in slices(batches, 1000):
            for doc_id, text, name in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "block")), strict=True):
                if block is not None and block.size + len(text) > BLOCK_BYTES:
                    yield from block.batches(tokenizers.get())
                    block = None
                if block is None:
                    block, nth = _Block(name, nth), nth + 1
                block.add(doc_id, text)
        if block is not None:
            yield from block.batches(tokenizers.get())

    return bucketed(dealt.mapInArrow(run, _ENCODED_SQL), "encoded", "block")


def _ends(words: DataFrame, side: str) -> DataFrame:
    """(word's key, end, place) of one side's tokens: lengths added up in order."""
    tokens = words.select(*WORD, F.posexplode(f"{side}_sizes").alias(side, "size"))
    return tokens.select(*WORD, side, F.sum("size").over(Window.partitionBy(*WORD).orderBy(side)).alias("end"))


def aligned(words: DataFrame) -> DataFrame:
    """(block, word, groups): a word's groups in order, each the ids and sizes of its A and B tokens."""
    cuts = _ends(words, "a").join(_ends(words, "b"), [*WORD, "end"])
    listed = cuts.groupBy(*WORD).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("cuts"))

    def group(cut: Column, i: Column) -> Column:
        """The tokens after the cut before, up to this one; its number is the count of cuts so far."""
        before = lambda side: F.when(i > 0, F.get("cuts", i - 1)[side]).otherwise(-1)
        part = lambda side, column: F.slice(column, before(side) + 2, cut[side] - before(side)).alias(column)
        return F.struct(*(part(c[0], c) for c in ("a", "b", "a_sizes", "b_sizes")))

    # One side's column "a" is a place, the other's the ids; the struct of places keeps them apart.
    met = words.select(*WORD, "a", "b", "a_sizes", "b_sizes").join(listed, WORD)
    return bucketed(met.select(*WORD, F.transform("cuts", group).alias("groups")), "aligned", "block")


def _id_pair(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 32) + b


def _is_small(group: Column) -> Column:
    return (F.least(F.size(group["a"]), F.size(group["b"])) == 1) | (F.size(group["a"]) * F.size(group["b"]) <= GROUP_PAIRS)


def _group_links(group: Column) -> Column:
    """All overlapping pairs of a small group."""
    every = F.flatten(F.transform(group["a"], lambda a: F.transform(group["b"], lambda b: _id_pair(a, b))))
    ends = lambda sizes: F.transform(F.sequence(F.lit(1), F.size(sizes)), lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda s, x: s + x))
    token = lambda ids, sizes: F.arrays_zip(ids.alias("id"), ends(sizes).alias("end"), sizes.alias("size"))
    over = lambda a, b: (a["end"] - a["size"] < b["end"]) & (b["end"] - b["size"] < a["end"])
    some = F.flatten(
        F.transform(token(group["a"], group["a_sizes"]), lambda a: F.transform(F.filter(token(group["b"], group["b_sizes"]), lambda b: over(a, b)), lambda b: _id_pair(a["id"], b["id"])))
    )
    return F.when(F.least(F.size(group["a"]), F.size(group["b"])) == 1, every).otherwise(some)


def _range_links(words: DataFrame) -> DataFrame:
    """(block, word, far): the links of long groups. Both sides are laid out by ranges of RANGE bytes, and a pair counts where it begins."""
    long = words.select(*WORD, F.posexplode("groups").alias("g", "group")).where(~_is_small(F.col("group")))
    key = [*WORD, "g"]

    def laid(side: str) -> DataFrame:
        tokens = long.select(*key, F.posexplode(F.arrays_zip(F.col(f"group.{side}").alias("id"), F.col(f"group.{side}_sizes").alias("size"))).alias("p", "t"))
        end = F.sum("t.size").over(Window.partitionBy(*key).orderBy("p"))
        spans = tokens.select(*key, F.col("t.id").alias(side), (end - F.col("t.size")).alias(f"{side}_start"), end.alias(f"{side}_end"))
        return spans.withColumn("range", F.explode(F.sequence(F.floor(F.col(f"{side}_start") / RANGE), F.floor((F.col(f"{side}_end") - 1) / RANGE))))

    met = laid("a").join(laid("b"), [*key, "range"]).where("a_start < b_end and b_start < a_end").where(F.floor(F.greatest("a_start", "b_start") / RANGE) == F.col("range"))
    return met.groupBy(*WORD).agg(F.collect_list(_id_pair(F.col("a"), F.col("b"))).alias("far"))


def word_links(words: DataFrame) -> DataFrame:
    """(block, word, groups, pairs): all links of a word, an id pair as one number."""
    near = words.withColumn("pairs", F.flatten(F.transform(F.filter("groups", _is_small), _group_links)))
    far = stored(_range_links(words), "far")
    if far.isEmpty():
        return near
    return near.join(far, WORD, "left").withColumn("pairs", F.concat("pairs", F.coalesce("far", F.array().cast("array<bigint>")))).drop("far")


def pair_counts(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(pair, n, best): how many texts hold the pair linked, and whether that is the highest of its A id."""
    own = texts.select(*TEXT, "first", F.explode(F.array_distinct("words")).alias("w")).select(*TEXT, (F.col("first") + F.col("w")).alias("word"))
    held = own.join(words.select(*WORD, F.array_distinct("pairs").alias("pairs")), WORD)
    n = stored(held.select(*TEXT, F.explode("pairs").alias("pair")).distinct().groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    highest = n.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return stored(n.join(highest, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def align(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (`a1,a2|b1;a3|b2,b3`).

    Null and empty texts, and those whose tokens' bytes aren't the text's, have zeros and
    the empty text. Repeated rows and rows without doc_id each count as a document.
    """
    docs = documents_of(docs)
    some = F.coalesce(F.octet_length("text"), F.lit(0)) > 0
    rows = encoded(docs.where(some), tokenizers)
    texts = rows.where("text is not null").select(*TEXT, "first", "doc_id", "words")
    words = word_links(aligned(rows.where("word is not null")))
    counts = pair_counts(texts, words)
    # Each block's distinct pairs fetch their counts, rather than each word's.
    asked = words.select("block", F.explode(F.array_distinct("pairs")).alias("pair")).distinct()
    told = asked.join(counts, "pair")
    sums = words.select(*WORD, F.explode("pairs").alias("pair")).join(told, ["block", "pair"]).groupBy(*WORD).agg(F.count("*").alias("n_links"), F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum"))
    spelt = F.array_join(F.transform("groups", lambda g: F.concat(F.concat_ws(",", g["a"].cast("array<string>")), F.lit("|"), F.concat_ws(",", g["b"].cast("array<string>")))), ";")
    total = lambda side: F.aggregate("groups", F.lit(0).cast("long"), lambda s, g: s + F.size(g[side]))
    facts = words.select(*WORD, total("a").alias("n_a"), total("b").alias("n_b"), F.size("groups").cast("long").alias("n_groups"), spelt.alias("spelt")).join(sums, WORD)
    laid = texts.select(*TEXT, "doc_id", "first", F.posexplode_outer("words").alias("p", "w"))
    met = laid.select(*TEXT, "doc_id", "p", (F.col("first") + F.col("w")).alias("word")).join(facts, WORD, "left")
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("spelt").isNotNull(), F.struct("p", "spelt")))), lambda x: x["spelt"]), ";")
    found = met.groupBy(*TEXT, "doc_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names), listed.alias("groups"))
    none = docs.where(~some).select("doc_id", *(F.lit(0).cast("long").alias(c) for c in names), F.lit("").alias("groups"))
    return found.select("doc_id", *names, "groups").unionByName(none)
