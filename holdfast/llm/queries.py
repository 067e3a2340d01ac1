"""The operators of this folder on the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.clusters import cluster_rows
from holdfast.llm.hosts import filter_urls
from holdfast.llm.html import extract_text
from holdfast.llm.leaks import leaked_overlaps
from holdfast.llm.lines import without_shared_lines
from holdfast.llm.mixing import mix_strata
from holdfast.llm.passages import repeated_passages
from holdfast.llm.recompression import repeated_windows
from holdfast.llm.sharding import shard_rows
from holdfast.llm.simhash import near_copies
from holdfast.llm.spelling import spelling_groups
from holdfast.llm.toxicity import toxicity
from holdfast.llm.vectors import near_vectors

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """Documents whose labels teach nothing."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    return labels.where(~held_out()).select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"))


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where("quality is not null")
    return labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight"))


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(_table(spark, sf_dir, "documents"), id="doc_id")
    return found.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("entity_id").alias("component_id")
    )


def op2_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows(_table(spark, sf_dir, "documents"), id="doc_id").withColumnRenamed("id", "doc_id")


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the labels whose number is the page's; a page of low quality is bad."""
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("y"))
    found = filter_urls(_table(spark, sf_dir, "pages"), outcomes, RULES, id="page_id")
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(_table(spark, sf_dir, "documents"), training_targets(spark, sf_dir), id="doc_id")
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "predicted")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_strata(_table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir), id="doc_id", stratum="source")
    return mixed.withColumnRenamed("id", "doc_id")


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), id="doc_id", item_id="item_id")
    return found.withColumnRenamed("id", "doc_id")


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"), id="page_id").withColumnRenamed("id", "page_id")


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(_table(spark, sf_dir, "embeddings"), id="vec_id", features="embedding", y="label")
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("entity_id").alias("component_id"), "kept")


def op9_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(_table(spark, sf_dir, "documents"), id="doc_id").withColumnRenamed("id", "doc_id")


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"), id="doc_id").withColumnRenamed("id", "doc_id")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_rows(_table(spark, sf_dir, "embeddings"), id="vec_id", features="embedding")
    centroid = F.sha2(F.array_join(F.transform("centroid", lambda v: v.cast("string")), ","), 256)
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", centroid.alias("centroid_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(_table(spark, sf_dir, "documents"), noise=97, id="doc_id")


def op13_shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_shared_lines(_table(spark, sf_dir, "documents"), id="doc_id")
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_groups, op2_repeated_windows, op3_url_reputation, op4_toxicity, op5_mix_sources, op6_benchmark_leaks,
        op7_page_text, op8_near_vectors, op9_jump_shards, op10_repeated_passages, op11_centroid_clusters,
        op12_spelling_variants, op13_shared_lines, pipeline,
    )
}
