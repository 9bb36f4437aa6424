"""From documents to packed batches: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeweave.llm import knn_quality, length_buckets, line_dedup, quality_rules, simhash
from gradeweave.llm.common import prepare, table
from gradeweave.session import discard, materialize, scratch_run


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for bad go."""
    prepare(spark)
    return knn_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return quality_rules.keep_quality(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share go, but for one document's."""
    prepare(spark)
    return line_dedup.clean_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    prepare(spark)
    return simhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's bucket, batch and slot."""
    return length_buckets.pack(docs, length_buckets.word_pieces(F.col("text")))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the fingerprints; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written is removed once the next one is done."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch_run(spark) as folder:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        if before is not None:
            discard(spark, before)
        before = folder
    return docs
