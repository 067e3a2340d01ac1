"""Writing predictions, results, models and the manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.session import new_path

# The result families and the manifest columns.
FAMILIES = ("primary", "repeated_holdout", "baselines", "fairness", "statistics")
MANIFEST = T.StructType(
    [
        T.StructField("experiment", T.StringType()),
        T.StructField("script", T.StringType()),
        T.StructField("config", T.StringType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("input_fp", T.StringType()),
        T.StructField("result_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


def store(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a derived table to the shared folder once and read it from there.

    A cohort is read several times (quotas, thresholds, fit, score), so its joins and
    text functions should run once. Where the sources have fewer files than there are
    cores they are small, and the table is spread evenly so that later reads use all
    cores; otherwise it is written as it comes, without a shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    path = new_path(spark, name)
    spread = df.repartition(cores) if len(df.inputFiles()) < cores else df
    spread.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_predictions(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Predictions by experiment, strategy and seed.

    The rebalance hint lets adaptive execution split large partitions and join small
    ones, so file sizes stay even whatever the number of rows per seed.
    """
    parts = ["experiment", "strategy", "seed"]
    df.hint("rebalance", *parts).write.mode(mode).partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_results(df: DataFrame, family: str, path: str, csv: bool = False, mode: str = "errorifexists") -> DataFrame:
    """One results table under its family; CSV as well for small summaries."""
    if family not in FAMILIES:
        raise ValueError(f"unknown result family {family!r}")
    target = f"{path}/{family}"
    df.write.mode(mode).parquet(f"{target}/parquet")
    if csv:
        df.sparkSession.read.parquet(f"{target}/parquet").write.mode(mode).option("header", True).csv(f"{target}/csv")
    return df.sparkSession.read.parquet(f"{target}/parquet")


def save_model(model, meta: Mapping[str, str], path: str) -> str:
    """Save a fitted PipelineModel, and what is needed to identify it, side by side.

    Returns the model path; the registry under `path` gains one row.
    """
    spark = SparkSession.builder.getOrCreate()  # the active session is not known to other threads
    target = f"{path}/models/{meta['experiment']}-{meta['model']}-{meta['strategy']}-{meta['seed']}"
    model.write().save(target)
    row = {**{k: str(v) for k, v in meta.items()}, "path": target, "spark_version": spark.version}
    columns = ["experiment", "model", "strategy", "seed", "config", "preprocessing", "spark_version", "path"]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    spark.createDataFrame([tuple(row.get(c) for c in columns)], schema).write.mode("append").parquet(f"{path}/registry")
    return target


def save_parameters(params: DataFrame, meta: Mapping[str, str], path: str) -> str:
    """Fitted parameters of all seeds and strategies as one table, with what identifies them.

    `meta` names experiment, model, config and preprocessing. A second save of the same
    experiment and model is an error.
    """
    target = f"{path}/{meta['experiment']}-{meta['model']}"
    named = {f"meta_{k}": F.lit(str(v)) for k, v in meta.items()}
    kept = params.withColumns({**named, "meta_spark_version": F.lit(params.sparkSession.version)})
    kept.coalesce(1).write.parquet(target)
    return target


def load_parameters(spark: SparkSession, path: str, experiment: str, model: str, schema: T.StructType) -> DataFrame:
    """The table `save_parameters` wrote, in the columns of `schema`."""
    return spark.read.schema(schema).parquet(f"{path}/{experiment}-{model}")


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def model_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/registry")


def manifest_rows(
    metrics: DataFrame, script: str, config: str, input_fp: str, by: Sequence[str] = ("experiment", "seed")
) -> DataFrame:
    """One row per (experiment, seed); the result id is a digest of that seed's metrics."""
    line = F.concat_ws("|", "model", "strategy", "metric", F.round("value", 6).cast("decimal(18,6)").cast("string"))
    results = metrics.groupBy(*by).agg(
        F.md5(F.concat_ws(";", F.array_sort(F.collect_list(line)))).alias("result_id")
    )
    return results.select(
        "experiment",
        F.lit(script).alias("script"),
        F.lit(config).alias("config"),
        "seed",
        F.lit(input_fp).alias("input_fp"),
        "result_id",
        F.current_timestamp().alias("created_at"),
    )


def append_manifest(rows: DataFrame, path: str) -> DataFrame:
    spark = rows.sparkSession
    rows.select(*[F.col(f.name).cast(f.dataType) for f in MANIFEST]).write.mode("append").parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)
