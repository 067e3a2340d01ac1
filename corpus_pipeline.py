"""A text cohort from raw documents to shards, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, in the columns of
`documents`; the last one returns their shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm.common import keep
from holdfast.llm.leaks import without_leaks
from holdfast.llm.mixing import mixed_rows
from holdfast.llm.queries import quality_weights, training_targets
from holdfast.llm.sharding import shard_rows
from holdfast.llm.simhash import without_near_copies
from holdfast.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.3."""
    return toxicity(docs, training_targets(spark, sf_dir), 0.3, id="doc_id", carry=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return without_near_copies(docs, id="doc_id")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), item_id="item_id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, whole, as often as the mix takes them."""
    return mixed_rows(docs, quality_weights(spark, sf_dir), id="doc_id", stratum="source")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 of the mixed documents; copies of a document share its shard."""
    return shard_rows(docs, 8, id="doc_id").withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# The toxicity and fingerprint stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
