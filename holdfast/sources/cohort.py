"""Reading cohorts, seeds and experiment grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class CohortSpec:
    """How a stored table becomes a cohort. The schema is given, never inferred."""

    schema: T.StructType
    ident: str
    target: str
    features: Mapping[str, str] = field(default_factory=dict)
    attrs: Mapping[str, str] = field(default_factory=dict)
    entity: str | None = None


class CohortError(ValueError):
    pass


def load_cohort(spark: SparkSession, path: str, spec: CohortSpec, fmt: str = "parquet", **options: str) -> DataFrame:
    """Read with a fixed schema; null or repeated ids and targets outside {0,1} fail.

    The check is one aggregate over the id and the target columns only.
    """
    raw = spark.read.schema(spec.schema).options(**options).format(fmt).load(path)
    cohort = raw.select(
        F.col(spec.ident).cast("bigint").alias("id"),
        F.expr(spec.entity or spec.ident).alias("entity_id"),
        F.expr(spec.target).cast("int").alias("y"),
        *[F.expr(e).alias(n) for n, e in {**spec.features, **spec.attrs}.items()],
    )
    check_cohort(cohort)
    return cohort


def check_cohort(cohort: DataFrame) -> None:
    found = cohort.agg(
        F.count_if(F.col("id").isNull()).alias("null_ids"),
        (F.count("id") - F.count_distinct(F.col("id"))).alias("repeated_ids"),
        F.count_if(~F.coalesce(F.col("y").isin(0, 1), F.lit(False))).alias("bad_targets"),
    ).first()
    bad = {k: v for k, v in found.asDict().items() if v}
    if bad:
        raise CohortError(f"cohort rejected: {bad}")


def seed_table(spark: SparkSession, seeds: Sequence[int] | str) -> DataFrame:
    """The predefined seeds as rows, from a list or from a CSV file with a header."""
    schema = T.StructType([T.StructField("seed", T.IntegerType())])
    if isinstance(seeds, str):
        return spark.read.schema(schema).csv(seeds, header=True)
    return spark.createDataFrame([(int(s),) for s in seeds], schema)


def experiment_grid(
    seed_rows: DataFrame, strategies: Sequence[str], models: Sequence[str], params: Sequence[Mapping[str, str]] = ({},)
) -> DataFrame:
    """seeds x strategies x models x settings as rows: `(cell, seed, strategy, model, config)`."""
    listed = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    configs = [";".join(f"{k}={v}" for k, v in sorted(p.items())) for p in params]
    grid = (
        seed_rows.withColumn("strategy", listed(strategies))
        .withColumn("model", listed(models))
        .withColumn("config", listed(configs))
    )
    cell = F.md5(F.concat_ws("|", F.col("seed").cast("string"), "strategy", "model", "config"))
    return grid.select(cell.alias("cell"), "seed", "strategy", "model", "config")
