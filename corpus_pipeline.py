"""The training-data pipeline over documents: each stage works on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() applies them in order. The
last one, sharding, adds the shard and the slot to each row. Stages read docs more than once, so
run() writes each stage's rows to the shared folder before the next one reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from probitas.cluster import scratch
from probitas.llm.classifier import keep_good
from probitas.llm.common import table
from probitas.llm.decontaminate import drop_contaminated
from probitas.llm.mixing import apply_mix
from probitas.llm.sharding import shuffle_to_shards
from probitas.llm.similar import drop_similar


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    return drop_similar(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return apply_mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their shard and slot."""
    return shuffle_to_shards(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("source mixing", source_mixing),
    ("sharding", sharding),
]

#: Training, linking components and random permutations have no SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(step(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
