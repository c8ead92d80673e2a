"""A training corpus from raw documents: toxic ones out, repeated lines out, one of each near-duplicate group, sources mixed, bins packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import lines, mixing, packing, simhash, toxicity
from lectern.session import stage

CAPACITY = 2048  # words of a bin
FLATTEN = 0.7  # exponent of the sources' bytes in their target weights
SEED = 42


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.accepted(docs, toxicity.targets(labels))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_repeats(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, mixing.flattened(docs, FLATTEN), seed=SEED).select(*docs.columns)


def packed_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_bins(docs, capacity=CAPACITY)


STAGES = [
    ("toxicity", nontoxic),
    ("line_dedup", distinct_lines),
    ("simhash_dedup", distinct_documents),
    ("source_mix", mixed_sources),
    ("best_fit_packing", packed_bins),
]

#: A trained classifier and a packing heuristic have no SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
