"""Cohorts built from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_FEATURES = ["n_chars", "spaces", "word_len"]
ORDER_FEATURES = ["price", "month", "quantity", "extended", "discount"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents; the positive class is low quality."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    digits = F.length("text") - F.length(F.translate("text", "0123456789", ""))
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.md5("text").alias("entity_id"),
        (1 - F.col("quality")).cast("int").alias("y"),
        F.col("n_chars").cast("double").alias("n_chars"),
        spaces.cast("double").alias("spaces"),
        (F.col("n_chars").cast("double") / (1 + spaces).cast("double")).alias("word_len"),
        (digits.cast("double") / F.greatest(F.length("text"), F.lit(1)).cast("double")).alias("digit_share"),
        "lang",
        "source",
    )


def orders_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with line sums; the entity is the customer."""
    orders = table(spark, sf_dir, "orders")
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").alias("quantity"),
            F.sum("l_extendedprice").alias("extended"),
            F.avg("l_discount").alias("discount"),
        )
    )
    places = (
        table(spark, sf_dir, "customer")
        .select("c_custkey", "c_nationkey", "c_mktsegment")
        .join(
            table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"),
            F.col("c_nationkey") == F.col("n_nationkey"),
        )
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"))
    )
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(places, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("entity_id"),
            (F.col("o_orderstatus") == "F").cast("int").alias("y"),
            F.col("o_totalprice").alias("price"),
            F.month("o_orderdate").cast("double").alias("month"),
            "quantity",
            "extended",
            "discount",
            "segment",
            "region",
            F.col("o_orderpriority").alias("priority"),
        )
    )


def emb_cohort(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    """Embedding vectors, one column per dimension; the positive class is label 0."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").alias("id"),
        (F.col("label") == 0).cast("int").alias("y"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(dims)],
    )
