"""From raw documents to token ids: five stages, each a Parquet table that the next one reads.

toxicity       rows that the network scores at or above its threshold go
line dedup     lines that three or more documents share stay in one document only
near dedup     one document of each SimHash group stays, that of the smallest doc_id
decontaminate  rows contaminated by the benchmark go
sentencepiece  ids of each text that is left

All stages but the last return the columns of documents. The first needs a trained network
and the third a component search, so SQL can't express the whole; tests hold the rows
against a plain version of every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyrank.llm import decontaminate, line_dedup, sentencepiece_codec, simhash, toxicity
from tallyrank.llm.common import scratch_scope, table
from tallyrank.session import scratch


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(docs, sentencepiece_codec.Codec(spark))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("decontaminate", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage stores on its way is removed once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        with scratch_scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
