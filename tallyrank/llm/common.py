"""What the corpus operators share: stored tables, text columns, batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, scratch_scope, stored

__all__ = ["ascii_lower", "bucketed", "documents_of", "fresh", "scratch", "scratch_scope", "slices", "stored", "table", "utf8"]

#: Space, tab, line feed, vertical tab, form feed and carriage return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of letters a-z, digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does the same, and faster, where all is ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until docs has no such column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def documents_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no further column of docs can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """Like stored(), in buckets of the column: joins and windows by it (and more) then move no row.

    As many buckets as shuffle partitions; a df that is dealt by the column already writes a file each.
    Sets spark.sql.requireAllClusterKeysForCoPartition to false in the session, without which a join by
    the column and more would deal both sides anew.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    df.write.option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).option("path", scratch(spark, name)).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # its name alone: out goes on reading the files
    return out


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


#: A slice of more bytes is halved, down to one row.
SLICE_BYTES = 1 << 24


def slices(batches: Iterable[pa.RecordBatch], rows: int, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many at most and size (SLICE_BYTES) or one row, to bound what Python holds."""
    size = size or SLICE_BYTES

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows > 1 and batch.nbytes > size:
            middle = batch.num_rows // 2
            yield from cut(batch.slice(0, middle))
            yield from cut(batch.slice(middle))
        else:
            yield batch

    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield from cut(batch.slice(start, rows))
