"""License labels: exact phrases, and a set-similarity join of text blocks with templates.

The join is exact. Template tokens are ordered by how many documents hold them, counted
over all documents. A block that holds at least ceil(t * |T|) of a template's tokens
must hold one of its |T| - ceil(t * |T|) + 1 rarest, the prefix; an index from prefix
tokens to templates proposes pairs, the length filter asks for enough tokens in the block,
the positional filter for enough left behind the match on both sides, and what is left
is counted. A template's blocks are all runs of BLOCK_FACTOR times its words, whatever lines
they stand in: the join first meets the whole text, whose words hold those of every block, and
templates that pass slide over the stretches around their prefix tokens.

Licenses quote each other, so templates overlap. Of the blocks that share words, the one with the
best containment counts, then that of the larger template, then the tightest; what lies
left and right of it is judged by itself. Where one word tells a family's licenses apart, containment
can't: such words are named with the template, and a block counts only if it holds the template's own and,
up to REACH words on, none of its siblings'. A notice of the GPL is thus none of the AGPL or LGPL,
Attribution-NoDerivs isn't Attribution, and a text with several notices has all their labels.

Templates are a small parameter, so they travel to the texts; no text moves.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import product
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, slices, utf8

# Phrases that name a license outright.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Words that tell a family's licenses apart: a block needs those of its template, and has none of the others.
GNU_NAMES = frozenset({"affero", "lesser"})
GNU = GNU_NAMES | {"2", "3"}
CC = frozenset("noncommercial non commercial sharealike share alike noderivatives noderivs no derivatives derivs derivative".split())
_NC, _SA = ("noncommercial", "non commercial"), ("sharealike", "share alike")
_ND = ("noderivatives", "noderivs", "no derivatives", "no derivs", "no derivative works")
# Public license notices, openings or whole, and statements, by label.
_OPENING = "this is free software you can redistribute it and or modify it under the terms of the gnu {name}"
_NOTICE = _OPENING + " as published by the free software foundation either version {version} of the license or at your option any later version"
_ONLY = _OPENING + " version {version} as published by the free software foundation"
_STATEMENT = "licensed under the gnu {name} version {version}"
_CC = "this work is licensed under a creative commons attribution {terms} license"
_GNU_LICENSES = (("gpl", "general public license", ("2", "3")), ("agpl", "affero general public license", ("3",)), ("lgpl", "lesser general public license", ("2.1", "3")))
TEMPLATES = (
    *((f"{label}-{version}", form.format(name=name, version=version.replace(".", " ")), GNU) for label, name, versions in _GNU_LICENSES for version in versions for form in (_NOTICE, _ONLY, _STATEMENT)),
    *((label, _OPENING.format(name=name), GNU_NAMES) for label, name in (("gpl", "general public license"), ("agpl-3", "affero general public license"), ("lgpl", "lesser general public license"))),
    *(("-".join(("cc-by", *parts)), _CC.format(terms=" ".join(terms)), CC)
      for parts, spelt in (((), ()), (("sa",), (_SA,)), (("nc",), (_NC,)), (("nd",), (_ND,)), (("nc", "sa"), (_NC, _SA)), (("nc", "nd"), (_NC, _ND))) for terms in product(*spelt)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
)
THRESHOLD = 0.8
#: A template's block is a run of so many times its words.
BLOCK_FACTOR = 2
#: A name goes on so many words behind what a block holds of it: "Attribution" may be that of "Attribution-NonCommercial".
REACH = 6

#: A-Z to a-z, every other ASCII character but a-z and 0-9 to a space; what lies beyond ASCII stays.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Templates:
    """Templates in frequency order with their prefix index.

    A template is (label, text), or (label, text, marks) with the words that tell its family apart.
    """

    def __init__(self, templates: Sequence[tuple], frequency: Mapping[bytes, int], threshold: float = THRESHOLD, factor: int = BLOCK_FACTOR):
        held = [(label, text.encode().split()) for label, text, *_ in templates]
        marks = [{m.encode() for m in (t[2] if len(t) > 2 else ())} for t in templates]
        every = sorted({w for _, words in held for w in words}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(every)}
        self.labels = [label for label, _ in held]
        self.sets = [{*words} for _, words in held]
        self.own = [m & words for m, words in zip(marks, self.sets, strict=True)]
        self.foreign = [m - words for m, words in zip(marks, self.sets, strict=True)]
        self.block = [factor * len(words) for _, words in held]
        self.tokens = [sorted(words, key=self.rank.__getitem__) for words in self.sets]
        self.need = [ceil(threshold * len(words) - 1e-9) for words in self.sets]
        self.prefix = [{*tokens[: len(tokens) - need + 1]} for tokens, need in zip(self.tokens, self.need, strict=True)]
        self.index: dict[bytes, list[tuple[int, int]]] = {}
        for k, (tokens, prefix) in enumerate(zip(self.tokens, self.prefix, strict=True)):
            for p, w in enumerate(tokens[: len(prefix)]):
                self.index.setdefault(w, []).append((k, p))

    def matches(self, words: Iterable[bytes]) -> list[int]:
        """The templates that all of these words, taken together, hold to the threshold."""
        own = sorted(self.rank.keys() & set(words), key=self.rank.__getitem__)
        found, tried = [], set()
        for q, w in enumerate(own):
            for k, p in self.index.get(w, ()):
                # q and p are the first match in both orders: nothing before them is shared.
                if k in tried or len(own) < self.need[k]:
                    continue
                tried.add(k)
                if min(len(self.tokens[k]) - p, len(own) - q) < self.need[k]:
                    continue
                if len(self.sets[k].intersection(own)) >= self.need[k]:
                    found.append(k)
        return sorted(found)

    def windows(self, k: int, words: list[bytes], first: int, end: int) -> list[tuple[int, int, int]]:
        """(held, start, stop) of the tightest stretch before each end that holds most of template k, where it meets the threshold."""
        reach, sought, foreign, out = self.block[k], self.sets[k], self.foreign[k], []
        # A block without a prefix token can't meet the threshold, so only what lies near one is walked.
        near, at = [], first
        for p in (i for i in range(first, end) if words[i] in self.prefix[k]):
            near += range(max(at, p - reach + 1), min(end, p + reach))
            at = max(at, min(end, p + reach))
        held: dict[bytes, int] = {}
        places: list[int] = []
        left = 0
        for i in near:
            w = words[i]
            if w in foreign:  # no block goes over it
                held, places, left = {}, [], 0
            if w not in sought:
                continue
            places.append(i)
            held[w] = held.get(w, 0) + 1
            while places[left] <= i - reach or held[words[places[left]]] > 1:
                gone = words[places[left]]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
                left += 1
            if len(held) >= self.need[k] and self.own[k] <= held.keys() and foreign.isdisjoint(words[i + 1 : i + 1 + REACH]):
                out.append((len(held), places[left], i + 1))
        return out

    def blocks(self, words: list[bytes]) -> list[tuple[str, float, int, int]]:
        """(label, containment, start, stop) of the blocks that count, no two of which share a word."""
        out, todo = [], [(0, len(words), self.matches(words))]
        while todo:
            first, end, some = todo.pop()
            found = {k: self.windows(k, words, first, end) for k in some}
            best = min((((-h / len(self.sets[k]), -len(self.sets[k]), b - a, k)) for k, w in found.items() for h, a, b in w), default=None)
            if best is None:
                continue
            share, _, span, k = best
            at, rest = first, [i for i in some if found[i]]
            for h, a, b in found[k]:
                if -h / len(self.sets[k]) == share and b - a == span and a >= at:
                    out.append((self.labels[k], -share, a, b))
                    todo.append((at, a, rest))
                    at = b
            todo.append((at, end, rest))
        return sorted(out, key=lambda x: x[2])


def phrase_starts(words: list[bytes], phrase: bytes) -> list[int]:
    """The word numbers where the phrase's words stand one after the other."""
    joined, sought, starts, at = b" " + b" ".join(words) + b" ", b" " + phrase + b" ", [], -1
    if sought not in joined:
        return []
    last, count = 0, 0
    while (at := joined.find(sought, at + 1)) >= 0:
        count, last = count + joined.count(b" ", last, at), at
        starts.append(count)
    return starts


def token_frequencies(docs: DataFrame, templates: Sequence[tuple] = TEMPLATES) -> dict[bytes, int]:
    """In how many documents each template token stands; as many entries as templates have tokens."""
    vocabulary = {w for _, text, *_ in templates for w in text.encode().split()}

    def run(batches):
        counts = dict.fromkeys(vocabulary, 0)
        for batch in slices(batches, 1000):
            for text in utf8(batch.column("text")):
                for w in vocabulary.intersection(words_of(text)):
                    counts[w] += 1
        yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())}, pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    counted = documents_of(docs).select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}


_BLOCK = pa.struct([("label", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])
_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label: string, containment: double, first_word: long, end_word: long>>"
_FIELDS = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("blocks", pa.list_(_BLOCK))])


def scan(docs: DataFrame, templates: Sequence[tuple] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = THRESHOLD, block_factor: int = BLOCK_FACTOR) -> DataFrame:
    """One row per row of docs with its license phrases, labels, score, and the blocks that templates found.

    score is 1 with a phrase, else the best containment among the blocks, else 0. Null and empty
    texts have no words, no labels (empty strings) and score 0. Repeated rows and null ids
    are each returned.
    """
    joined = Templates(templates, token_frequencies(docs, templates), threshold, block_factor)
    sought = [(p.encode(), label) for p, label in phrases.items()]

    def run(batches):
        prefix = joined.index.keys()
        for batch in slices(batches, 1000):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                words = words_of(text)
                starts, base = [], set()
                for phrase, label in sought:
                    if at := phrase_starts(words, phrase):
                        starts += at
                        base.add(label)
                blocks = [] if prefix.isdisjoint(words) else joined.blocks(words)
                score = 1.0 if base else max((share for _, share, _, _ in blocks), default=0.0)
                listed = [dict(zip(("label", "containment", "first_word", "end_word"), b, strict=True)) for b in blocks]
                rows.append((doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base.union(b[0] for b in blocks))), score, listed))
            yield pa.RecordBatch.from_pydict(dict(zip(_FIELDS.names, zip(*rows, strict=True), strict=True)), _FIELDS)

    return documents_of(docs).mapInArrow(run, _SCHEMA)
