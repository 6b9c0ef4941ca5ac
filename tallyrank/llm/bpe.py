"""A byte-level BPE encoder from a public vocabulary file, shipped to the executors."""

from __future__ import annotations

import base64
from pathlib import Path

from pyspark.sql import SparkSession

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the public pre-token pattern of these vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_made: dict = {}


class Encoder:
    """Reads the vocabulary (under 1 MB) on the driver; each Python worker builds it once."""

    def __init__(self, spark: SparkSession, vocabulary: str = VOCABULARY, tokenizers: str = TOKENIZERS):
        self.name = vocabulary.rsplit(".", 1)[0]
        self.data = spark.sparkContext.broadcast((Path(tokenizers) / vocabulary).read_bytes())

    def get(self):
        if self.name not in _made:
            import tiktoken

            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, self.data.value.splitlines())}
            _made[self.name] = tiktoken.Encoding(self.name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return _made[self.name]

    @property
    def n_ids(self) -> int:
        return len(self.data.value.splitlines())
