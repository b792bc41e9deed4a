"""Labelled rows that a classifier may learn from, bounded by a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import held_out

#: labelled rows that a model is fitted on, at most
SAMPLE = 12_000


def training_texts(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """(text, label) of at most `sample` labelled documents that are not held out.

    The sample is the rows with the smallest hashes of doc_id, so it is the same each time and
    independent of the order of rows. Null labels and ids are left out; of several labels of one
    document the larger one holds, of several rows the largest text. The sample is bounded, so
    it is broadcast to the documents.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("_label").alias("label"))


def in_order(rows):
    """An Arrow table of training rows in an order that doesn't depend on the partitions."""
    return rows.toArrow().sort_by([("doc_id", "ascending")])
