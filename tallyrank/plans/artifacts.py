"""Versioned model folders: tables written under a version, then a pointer moved to it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import Folder


def data_fingerprint(products: DataFrame, events: DataFrame) -> DataFrame:
    """One row, fingerprint: 12 hex digits of the counts, the latest time and the products' columns."""
    n = products.agg(F.count("*").alias("n_products"))
    e = events.agg(F.count("*").alias("n_events"), F.unix_micros(F.max("timestamp")).alias("latest"))
    text = F.concat(F.lit("products="), F.col("n_products").cast("string"), F.lit("|events="), F.col("n_events").cast("string"), F.lit("|max_ts="), F.coalesce(F.col("latest").cast("string"), F.lit("")), F.lit("|cols=" + ",".join(sorted(products.columns))))
    return n.crossJoin(F.broadcast(e)).select(F.substring(F.sha2(text, 256), 1, 12).alias("fingerprint"))  # one row each


class ArtifactStore:
    """Readers see the version that CURRENT names; a half-written one is never named."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = Folder(spark, self.path)

    def _write(self, name: str, text: str) -> None:
        self._files.write(name, text.encode())

    def _text(self, name: str) -> str | None:
        found = self._files.read(name)
        return None if found is None else found.decode(errors="replace")

    def save(self, version: str, tables: Mapping[str, DataFrame], meta: dict) -> None:
        folder = f"v={version}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{folder}/{name}")
        self._files.make(folder)
        full = {"version": version, "folder": folder, "tables": sorted(tables), "trained_at": datetime.now(UTC).isoformat(), **meta}
        self._write(f"{folder}/meta.json", json.dumps(full, indent=2, default=str))
        self._write("CURRENT", folder)

    def load(self) -> tuple[dict, dict[str, DataFrame]] | None:
        """(meta, tables) of the current version; None if there is none or its meta can't be read."""
        folder = self._text("CURRENT")
        meta = self.load_json(f"{folder}/meta.json") if folder else None
        if not isinstance(meta, dict) or "tables" not in meta:
            return None
        return meta, {name: self.spark.read.parquet(f"{self.path}/{folder}/{name}") for name in meta["tables"]}

    def save_json(self, name: str, data) -> None:
        self._write(name, json.dumps(data, indent=2, default=str))

    def load_json(self, name: str):
        """The file's content; None if it is missing or no JSON."""
        text = self._text(name)
        try:
            return json.loads(text) if text else None
        except ValueError:
            return None
