"""SentencePiece ids by a Viterbi search that words with a common prefix share.

Pieces never hold a space after another character, so the best segmentation of a text is
that of its marked words (their leading spaces included) one after the other. Per batch the
distinct unknown words are sorted, which lays them out as a trie in depth-first order; the
forward scores of the prefix that a word has in common with the one before stay, and only
the rest is searched, backwards from each end through a trie of reversed pieces. Results
are kept per worker up to a bounded number of words.

The score of a segmentation is the sum of its pieces' scores. A character that is no
piece of its own costs ten below the least score and is written as its UTF-8 bytes, so every
text decodes to itself. Ties go to the longer last piece.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_of, slices

TOKENIZERS = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words kept per Python worker (beyond them and a batch's, all are dropped), and the longest of them in characters.
KEPT_WORDS = 100_000
KEPT_CHARS = 48
#: Texts split into words at once.
BATCH_TEXTS = 500

_WORDS = re.compile(r" *[^ ]+| +")
_made: dict = {}


class Pieces:
    """A model's pieces as a trie of reversed texts, and its ids' bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_id: dict[int, int] = {}
        self.text: list[bytes] = []
        self.root: dict = {}
        least = 0.0
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_id[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} goes on over a space")
                self.text.append(piece.replace(MARK, " ").encode())
                least = min(least, sp.get_score(i))
                node = self.root
                for c in reversed(piece.replace(MARK, " ")):
                    node = node.setdefault(c, {})
                node[""] = (sp.get_score(i), i)
        if len(self.bytes_id) != 256:
            raise ValueError("the model has no byte pieces, so not every text could be decoded")
        self.unknown = least - UNKNOWN_PENALTY
        self.known: dict[str, bytes] = {}

    def search(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids (as little-endian 32-bit bytes) of distinct words."""
        found, root, unknown = {}, self.root, self.unknown
        scores, back, last = [0.0], [None], ""
        for word in sorted(words):
            common, most = 0, min(len(word), len(last))
            while common < most and word[common] == last[common]:
                common += 1
            del scores[common + 1 :], back[common + 1 :]
            for end in range(common, len(word)):
                node, best, how, at = root.get(word[end]), None, None, end
                single = node is not None and "" in node
                while node is not None:
                    if (own := node.get("")) is not None and (best is None or scores[at] + own[0] >= best):
                        best, how = scores[at] + own[0], (at, own[1])
                    at -= 1
                    if at < 0:
                        break
                    node = node.get(word[at])
                if not single and (best is None or scores[end] + unknown > best):
                    best, how = scores[end] + unknown, (end, -1)
                scores.append(best)
                back.append(how)
            ids, at = [], len(word)
            while at:
                start, i = back[at]
                ids += [i] if i >= 0 else [self.bytes_id[b] for b in reversed(word[start:at].encode())]
                at = start
            found[word] = np.array(ids[::-1], "<i4").tobytes()
            last = word
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit bytes; null and empty texts have none."""
        split, fresh = [], set()
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        for text in texts:
            words = _WORDS.findall(" " + text) if text else []
            split.append(words)
            fresh.update(words)
        fresh.difference_update(known)
        new = self.search(fresh)
        known.update((w, x) for w, x in new.items() if len(w) <= KEPT_CHARS)
        long = {w: x for w, x in new.items() if len(w) > KEPT_CHARS}
        if not long:
            return [b"".join(map(known.__getitem__, words)) for words in split]
        return [b"".join([known[w] if w in known else long[w] for w in words]) for words in split]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; the space that encoding put in front is taken off."""
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


class Codec:
    """Reads the model (under 1 MB) on the driver; each Python worker builds its trie once."""

    def __init__(self, spark: SparkSession, model: str = MODEL, tokenizers: str = TOKENIZERS):
        self.name = model
        self.data = spark.sparkContext.broadcast((Path(tokenizers) / model).read_bytes())

    def get(self) -> Pieces:
        if self.name not in _made:
            _made[self.name] = Pieces(self.data.value)
        return _made[self.name]


_SCHEMA = "doc_id long, n_ids long, ids array<int>, ids_sha256 string, round_trip boolean"
_NAMES = ["doc_id", "n_ids", "ids", "ids_sha256", "round_trip"]


def encode_documents(docs: DataFrame, codec: Codec) -> DataFrame:
    """Per row of docs: doc_id, n_ids, ids, ids_sha256 (over little-endian 32-bit ids), round_trip.

    round_trip tells whether the ids decode to the whole text. A null or empty text has no
    ids and decodes to the empty text. Repeated rows and null ids are each returned.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec.get()
        for batch in slices(batches, BATCH_TEXTS):
            texts = batch.column("text").to_pylist()
            held = pieces.encode(texts)
            flat = np.frombuffer(b"".join(held), "<i4")
            ends = np.cumsum([0, *(len(x) // 4 for x in held)])
            same = [pieces.decode(flat[a:b].tolist()) == (t or "") for t, a, b in zip(texts, ends, ends[1:], strict=False)]
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), ids, pa.array([hashlib.sha256(x).hexdigest() for x in held]), pa.array(same, pa.bool_())], _NAMES)

    return documents_of(docs).mapInArrow(run, _SCHEMA)


def decode_documents(encoded: DataFrame, codec: Codec) -> DataFrame:
    """(doc_id, text) of ids; a null array gives a null text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_TEXTS):
            texts = [None if x is None else codec.get().decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
