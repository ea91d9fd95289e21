"""A pipeline over documents: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salvor.llm import decontamination, exact_dedup, jaccard, mixing, toxicity
from salvor.llm.words import fold_of
from salvor.runtime import cut, cut_counted, small

REJECTED_FROM = 0.5


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose doc_id is not in ``gone`` (null ids stay)."""
    gone, found = cut_counted(gone.select(F.col("doc_id").alias("_gone")).distinct(), "gone", rows=F.lit(True))
    return docs.join(small(gone, found["rows"]), F.col("doc_id") == F.col("_gone"), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half.

    Learns from the labelled documents whose crc32(doc_id as text) mod 5 is not
    0; documents that have a label are judged by their score as well.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold_of(F.col("doc_id")) != 0)
    model = toxicity.fit_toxicity(toxicity.labelled(docs, labels))
    scores = toxicity.score_toxicity(docs, model)
    return _without(docs, scores.where(F.col("score") >= REJECTED_FROM))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 or more over five-word shingles the smallest doc_id."""
    found = jaccard.jaccard_components(docs, k=5, num=80, den=100, count=False)
    return _without(docs, found.where("doc_id <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontamination.contaminated(docs, benchmark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document."""
    items = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix_sources(items)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]
# The fitted models cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
