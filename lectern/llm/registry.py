"""One query per operator over its whole table, with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import centroids, importance, lines, lm, mixing, packing, quality, repeats, secrets, sharding, simhash, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"), shards=24)


@query("op4_secret_scan", secrets.digest_sql("documents"))
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scanned(_table(spark, sf_dir, "documents")))


@query("op5_quality_rules", quality.judged_sql("documents"))
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents")).drop("lang", "source")


@query("op6_poisson_mix", mixing.mix_sql("documents", 0.7, 42))
def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mixed(docs, mixing.flattened(docs, 0.7), seed=42)


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(_table(spark, sf_dir, "documents"))


@query("op1_repeats")
def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(_table(spark, sf_dir, "documents")).drop("removed")


@query("op2_topk", topk.nearest_sql("embeddings", 50))
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", topk.quantized(F.col("embedding")).alias("vector"))
    return topk.nearest(vectors, F.col("vec_id") % 50 == 0, k=5)


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_bins(_table(spark, sf_dir, "documents"), capacity=2048)


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_repeats(_table(spark, sf_dir, "documents"), count="n_removed").select("doc_id", "text", "n_removed")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(_table(spark, sf_dir, "documents"), toxicity.targets(_table(spark, sf_dir, "labels")))


@query("op11_centroids", centroids.clustered_sql("embeddings"))
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", centroids.scaled(F.col("embedding"), 64, width=64).alias("vector"))
    return centroids.digest(*centroids.clustered(vectors, k=16, rounds=3, seed=1))


@query("op12_importance")
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10, seed=2024)


@query("op13_lm_scoring")
def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = lm.held_out(F.col("doc_id"))
    model = lm.fit(docs.where(~held))
    scores = lm.scored(docs, model, keep={"held_out": held})
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
