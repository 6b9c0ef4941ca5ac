"""Token totals by source, language and tokenizer version, kept by signed changes.

A batch of inserts, revisions and deletes is joined with the ledger's rows for its
keys alone. What a key had is subtracted and what it now has is added, so totals are
sums over the batches' small delta tables and never need a recount. A batch is written
under a fresh name and counts once its commit file exists; the same batch id again
does nothing. One writer at a time; readers see committed batches only.

Layout under path: batches/<attempt>/{ledger,deltas} and commits/<batch id>, which names the attempt;
bases/<attempt> names a compaction of all batches up to a number. Ledgers lie in buckets of the key, and a batch
reads those of its own keys.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import Folder
from .bpe import Encoder
from .common import slices

KEY = ("doc_key", "tokenizer")
CELL = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_chars")
_LEDGER = "doc_key string, tokenizer string, source string, lang string, n_tokens long, n_chars long, live boolean, batch long, n_docs long"
#: Folders of a ledger, by a hash of the key.
BUCKETS = 64
_BUCKETED = f"{_LEDGER}, bucket int"
_DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


def _state() -> Column:
    """What the ledger says of a key; rows written before n_docs was kept stand for one document."""
    return F.struct("source", "lang", "n_tokens", "n_chars", "live", F.coalesce("n_docs", F.lit(1).cast("long")).alias("n_docs"))


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int")


def count_changes(docs: DataFrame, encoder: Encoder, op: str = "insert") -> DataFrame:
    """docs as changes: whole texts tokenized.

    doc_key is the doc_id, or a hash of source, language and text where that is null; rows
    without an id that are equal in these are one change whose n_docs, n_tokens and n_chars
    count them all. Rows of one doc_id are states of one document. A null text has no tokens.
    """
    cell = F.to_json(F.struct(F.col("source").cast("string").alias("s"), F.col("lang").cast("string").alias("l")), {"ignoreNullFields": "false"})
    whole = F.concat(cell, F.lit("\n"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.sha2(whole, 256)))
    own = docs.select(key.alias("doc_key"), F.col("doc_id").isNull().alias("no_id"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))

    def run(batches: Iterable[pa.RecordBatch]):
        encode = encoder.get().encode_ordinary
        for batch in slices(batches, 1000):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            counts = [pa.array([len(f(x)) for x in texts], pa.int64()) for f in (encode, str)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_key", "no_id", "source", "lang")), *counts], ["doc_key", "no_id", "source", "lang", "n_tokens", "n_chars"])

    counted = own.mapInArrow(run, "doc_key string, no_id boolean, source string, lang string, n_tokens long, n_chars long")
    equal = counted.groupBy("doc_key", "no_id", "source", "lang", "n_tokens", "n_chars").agg(F.count("*").alias("n"))
    n = F.when(F.col("no_id"), F.col("n")).otherwise(F.lit(1).cast("long"))
    return equal.select("doc_key", "source", "lang", (n * F.col("n_tokens")).alias("n_tokens"), (n * F.col("n_chars")).alias("n_chars"), n.alias("n_docs"), F.lit(encoder.name).alias("tokenizer"), F.lit(op).alias("op"))


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = Folder(spark, self.path)
        self._known: dict[str, dict] = {}

    def _entries(self, folder: str) -> list[dict]:
        """A folder's small files, by batch number; they never change, so each is read once."""
        names = [f"{folder}/{x}" for x in self._files.names(folder)]
        for name in names:
            if name not in self._known:
                self._known[name] = json.loads(self._files.read(name))
        return sorted((self._known[name] for name in names), key=lambda c: c["batch"])

    def _commits(self) -> list[dict]:
        """The committed batches, oldest first."""
        return self._entries("commits")

    def _base(self) -> dict | None:
        """The newest compaction: it stands for every batch up to its number."""
        return next(reversed(self._entries("bases")), None)

    def _commit(self, batch_id: str, entry: dict) -> None:
        """The rename is what commits: before it, readers see none of the batch."""
        try:
            self._files.write(f"commits/{batch_id}", json.dumps(entry).encode(), replace=False)
        except FileExistsError:
            raise RuntimeError(f"batch {batch_id} was committed by another writer") from None

    def _read(self, part: str) -> DataFrame:
        schema = {"ledger": _BUCKETED, "deltas": _DELTAS}[part]
        base, commits = self._base(), self._commits()
        paths = [f"{self.path}/batches/{c['attempt']}/{part}" for c in commits if base is None or c["batch"] > base["batch"]]
        paths += [f"{self.path}/batches/{base['attempt']}/{part}"] if base else []
        if part == "ledger":  # each has bucket folders of its own, so they are read one by one
            return reduce(DataFrame.unionByName, (self.spark.read.schema(schema).parquet(p) for p in paths), self.spark.createDataFrame([], schema))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def compact(self) -> None:
        """One table of each key's last state and one of the totals in place of all batches so far; the results stay.

        The ledger is sorted by key within files, so that a batch's keys skip row groups. What it stands for stays until vacuum().
        """
        done = self._commits()
        if not done:
            return
        last = done[-1]["batch"]
        attempt = f"base-{last:09d}.{uuid.uuid4().hex}"
        target = f"{self.path}/batches/{attempt}"
        states = self._read("ledger").groupBy(*KEY).agg(F.max_by(F.struct(*(c for c in self._ledger_columns() if c not in KEY)), "batch").alias("s")).select(*KEY, "s.*")
        self._laid(states).parquet(f"{target}/ledger")
        self._read("deltas").groupBy(*CELL).agg(*(F.sum(c).alias(c) for c in SUMS)).write.parquet(f"{target}/deltas")
        self._files.write(f"bases/{attempt}", json.dumps({"batch": last, "attempt": attempt}).encode())

    def vacuum(self) -> None:
        """Remove attempts that failed or that a compaction stands for. No reader or writer may be at work."""
        base = self._base()
        needed = {c["attempt"] for c in self._commits() if base is None or c["batch"] > base["batch"]} | ({base["attempt"]} if base else set())
        for attempt in self._files.names("batches"):
            if attempt not in needed:
                self._files.remove(f"batches/{attempt}")

    @classmethod
    def _laid(cls, states: DataFrame):
        rows = states.select(*cls._ledger_columns()).withColumn("bucket", _bucket()).repartition("bucket")
        return rows.sortWithinPartitions("bucket", *KEY).write.partitionBy("bucket")

    @staticmethod
    def _ledger_columns() -> list[str]:
        return [c.split()[0] for c in _LEDGER.split(", ")]

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it is committed already.

        changes: doc_key, tokenizer, op (insert, revise or delete), source, lang, n_tokens,
        n_chars, n_docs if a key can stand for several rows, and seq if a key can occur twice; then its highest seq counts, and among
        equals the largest row. An insert of a known key revises it, a revision of an
        unknown key inserts it, a delete of an unknown key is nothing. Null counts are 0.
        A null doc_key or an unknown op is refused when the batch is written.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch_id):
            raise ValueError(f"{batch_id!r} can't name a batch")
        done = self._commits()
        if any(c["id"] == batch_id for c in done):
            return False
        number, attempt = len(done), f"{batch_id}.{uuid.uuid4().hex}"
        seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
        n_docs = F.coalesce("n_docs", F.lit(1)) if "n_docs" in changes.columns else F.lit(1)
        known = F.coalesce(F.col("op").isin("insert", "revise", "delete"), F.lit(False)) & F.col("doc_key").isNotNull()
        live = F.when(known, F.col("op") != "delete").otherwise(F.raise_error(F.lit("a change needs a doc_key and an op of insert, revise or delete")))
        state = F.struct(seq.alias("seq"), live.alias("live"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"), "source", "lang", n_docs.cast("long").alias("n_docs"))
        now = changes.select(*KEY, state.alias("s")).groupBy(*KEY).agg(F.max("s").alias("s")).select(*KEY, "s.source", "s.lang", "s.n_tokens", "s.n_chars", "s.live", F.lit(number).cast("long").alias("batch"), "s.n_docs")
        target = f"{self.path}/batches/{attempt}"
        self._laid(now).parquet(f"{target}/ledger")
        now = self.spark.read.schema(_BUCKETED).parquet(f"{target}/ledger")
        signed = now.where("live").select(*CELL, F.lit(1).alias("sign"), *SUMS)
        if done:
            buckets = [r.bucket for r in now.select("bucket").distinct().collect()]  # at most BUCKETS
            older = self._read("ledger").where(F.col("bucket").isin(buckets)).join(now.select(*KEY), [*KEY], "left_semi")
            last = older.groupBy(*KEY).agg(F.max_by(_state(), "batch").alias("s")).select("tokenizer", "s.*").where("live")
            signed = signed.unionByName(last.select(*CELL, F.lit(-1).alias("sign"), *SUMS))
        deltas = signed.groupBy(*CELL).agg(*(F.sum(F.col("sign") * F.col(c)).alias(c) for c in SUMS))
        deltas.where("n_docs != 0 or n_tokens != 0 or n_chars != 0").write.parquet(f"{target}/deltas")
        self._commit(batch_id, {"id": batch_id, "batch": number, "attempt": attempt})
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_chars of all committed batches; no cell without documents."""
        return self._read("deltas").groupBy(*CELL).agg(*(F.sum(c).alias(c) for c in SUMS)).where("n_docs > 0")

    def recount(self) -> DataFrame:
        """The same totals from the ledger alone, for audits."""
        last = self._read("ledger").groupBy(*KEY).agg(F.max_by(_state(), "batch").alias("s")).select("tokenizer", "s.*").where("live")
        return last.groupBy(*CELL).agg(*(F.sum(c).alias(c) for c in SUMS))
