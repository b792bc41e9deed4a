"""From raw documents to a training mix: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.llm import fmindex, mixing, neardups, quality, templates
from dispatchlake.llm.common import cut

MIN_QUALITY = 0.3
#: bytes of texts that go to Python at once, unless the session says otherwise: executors and their workers hold several such batches
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """A stage whose texts go to Python in batches of `BATCH`; the session keeps that, as rows are computed later."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH[0], None) is None:
            spark.conf.set(BATCH[0], str(BATCH[1]))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; null and empty texts have a score too, rows that repeat one stay as often."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = quality.scorer(*quality.train(docs, labels))
    return docs.where(score(F.col("text")) >= MIN_QUALITY)


@in_small_batches
def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard similarity of 0.8 or more) one row, that with the smallest id.

    Texts without words, null ones included, are one group; of rows that repeat a document one stays.
    """
    return neardups.first_copies(docs)


@in_small_batches
def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in earlier ones; those of which nothing is left go.

    Texts that had no words from the start stay as they are, null ones too, and so do rows that
    repeat an id. Of a changed text, n_chars is counted anew.
    """
    others = [c for c in docs.columns if c != "text"]
    held = F.struct(F.col("text").isNull().alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    done = fmindex.remove_earlier_passages(docs.select("doc_id", "text", held.alias("held")), carry=("held",))
    done = done.where(~((F.col("n") > 0) & (F.octet_length("kept") == 0)))
    changed, kept = F.size("spans") > 0, F.col("kept").cast("string")
    fields = {c: F.col(f"row.held.c{i}") for i, c in enumerate(others)}
    fields["text"] = F.when(changed, kept).when(~F.col("row.held.none"), F.col("text"))
    if "n_chars" in fields:
        fields["n_chars"] = F.when(changed, F.length(kept).cast("long")).otherwise(fields["n_chars"])
    return done.select(*(fields[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


@in_small_batches
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, be it with other numbers and names; null and empty texts hold none."""
    judged = templates.judge(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.where(~F.col("contaminated")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: none of an empty one; a null source is one of its own."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", keep_first_copies),
    ("substring dedup", cut_passages),
    ("benchmark decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: a trained classifier decides the first stage, so SQL can't tell the rows
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over `documents`; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
