"""A pipeline over documents: quality, line dedup, near-duplicates, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps with the columns of documents; the last one returns
doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left.

Null texts are empty and rows without doc_id go through like others: of all rows that are near duplicates of each other, texts
without words included, the one with the least doc_id stays, nulls last. Rows with equal doc_id and different texts are
different documents. Without labels the first stage keeps all; an empty benchmark contaminates nothing; no rows give no rows.
Further columns of documents are kept by all stages but the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberframe.llm import bpe, decontaminate, lines, minhash, quality
from emberframe.llm.common import Scratch, read, small_batches


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.select(docs, read(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return lines.deduplicate(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return minhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.report(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

#: Models, weighted samples and merges are beyond SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return docs
