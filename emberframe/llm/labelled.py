"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points of a sample at most.
MAX_CHARS = 48_000_000


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, where: Column | None = None, most_chars: int = MAX_CHARS) -> list[tuple[str, int]]:
    """(text, label) of at most `most` labelled rows with at most `most_chars` code points together, those first by a hash of doc_id.

    `most` bounds what is broadcast, and both what comes to the driver; texts come whole or not at all. Texts of more than 1/64 of
    most_chars come after all others, so that one of them can't keep out what would still fit; if labelled texts are there but none
    fits, that is an error. Rows without a label or a doc_id are left out; of several labels of a document the least counts, of
    several texts the one with the least hash."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    own = own.where(where) if where is not None else own
    chosen = own.groupBy("doc_id").agg(F.min(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    each = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    single = each.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
    size = F.length("text").cast("long")
    upto = F.sum(size).over(Window.orderBy(size > most_chars // 64, F.xxhash64("doc_id"), "doc_id"))  # of at most `most` rows
    rows = single.where(size <= most_chars).withColumn("upto", upto).where(F.col("upto") <= most_chars).select("text", "label").collect()
    if not rows and not single.isEmpty():
        raise ValueError(f"no labelled text has at most {most_chars} code points")
    return [(r.text, r.label) for r in rows]
