"""The corpus pipeline: five stages, each over all that its predecessor kept.

Defined results, for every stage: an empty table gives no rows. Columns beyond those of documents are kept, whatever their
names; the last stage gives the pieces alone. Null ids are ids like any other and come last where ids are ordered. A null text
has no language and goes in the first stage, as does an empty one; later stages, each taken alone, keep both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventorium.llm import decontaminate, langid, near_duplicates, packing, personal_data
from inventorium.llm.common import new_path, remove, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression can tell; the model learns from the labels of ``docs``. Ties of two languages are
    narrow margins, so they go; repeated rows share one verdict."""
    return langid.accepted_only(docs, langid.train(docs.select("text", "lang")))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, linked by pairs with an exact five-word Jaccard of 0.8 or more: the smallest
    id. Of repeated rows one stays; texts without words are one group."""
    return near_duplicates.deduplicate_verified(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item; repeated rows stay or go together."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), 10, "documents")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text. Repeated rows stay repeated."""
    clean = personal_data.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens; repeated rows are packed once each."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicate),
    ("decontamination", benchmark),
    ("personal_data", private),
    ("packing", pack),
]

#: Compression sizes, components and tokens have no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again by the next stage, then removed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept, path = stage(spark, docs, sf_dir), new_path(spark, f"pipeline-{name}")
        kept.write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(kept.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
