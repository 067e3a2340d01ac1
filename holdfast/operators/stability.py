"""Spread over repeats, paired differences and seed reuse.

The metrics table is small (models x strategies x seeds x metrics); it is the output of
aggregates, so the windows and exact percentiles here see one row per seed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.functions.expr import ratio

BY = ["experiment", "model", "strategy", "metric"]
PAIR_BY = ["experiment", "model", "metric"]


def summarize(metrics: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Mean and sample SD over seeds, with the number of defined values."""
    return metrics.groupBy(*by).agg(
        F.count("value").alias("n_seeds"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def variation(metrics: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    out = metrics.groupBy(*by).agg(
        F.min("value").alias("min"),
        F.expr("percentile(value, 0.25D)").alias("q1"),
        F.expr("percentile(value, 0.5D)").alias("median"),
        F.expr("percentile(value, 0.75D)").alias("q3"),
        F.max("value").alias("max"),
        F.avg("value").alias("_m"),
        F.stddev_samp("value").alias("_s"),
    )
    return out.select(
        *by,
        "min",
        "q1",
        "median",
        "q3",
        "max",
        (F.col("max") - F.col("min")).alias("range"),
        ratio("_s", "_m").alias("cv"),
    )


def paired(
    metrics: DataFrame, a: str, b: str, by: Sequence[str] = PAIR_BY, side: str = "strategy"
) -> DataFrame:
    """b minus a on the same seed, matched by one aggregate instead of a self join."""
    both = metrics.filter(F.col(side).isin(a, b)).groupBy(*by, "seed").agg(
        F.max(F.when(F.col(side) == a, F.col("value"))).alias("a"),
        F.max(F.when(F.col(side) == b, F.col("value"))).alias("b"),
    )
    return both.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).withColumn(
        "diff", F.col("b") - F.col("a")
    )


def consistency(pairs: DataFrame, by: Sequence[str] = PAIR_BY) -> DataFrame:
    """Wins, ties and losses of b, and the share of seeds with the sign of the mean."""
    sign = F.signum(F.round("diff", 12)).cast("int")
    counts = pairs.groupBy(*by).agg(
        F.count("*").alias("n_seeds"),
        F.count_if(sign == 1).alias("wins"),
        F.count_if(sign == 0).alias("ties"),
        F.count_if(sign == -1).alias("losses"),
        F.avg("diff").alias("_mean"),
    )
    lead = F.signum(F.round("_mean", 12)).cast("int")
    agree = F.when(lead == 1, F.col("wins")).when(lead == -1, F.col("losses")).otherwise(F.col("ties"))
    return counts.withColumn("mean_sign", lead).withColumn("agree_share", ratio(agree, F.col("n_seeds"))).drop("_mean")


def flip_rate(pred: DataFrame) -> DataFrame:
    """Per row, the share of seeds in which its label is the rarer of the two."""
    by = ["experiment", "model", "strategy", "id"]
    out = pred.groupBy(*by).agg(
        F.count("*").alias("n_tested"), F.sum(F.col("y_pred").cast("bigint")).alias("n_pos")
    )
    rare = F.least(F.col("n_pos"), F.col("n_tested") - F.col("n_pos"))
    return out.withColumn("flip_rate", ratio(rare, F.col("n_tested")))


def reuse(splits: DataFrame) -> DataFrame:
    """Per pair of seeds, how many test rows they share.

    A row is first folded to the set of seeds testing it (at most one entry per seed);
    pairs are counted map-side from that set, so no self join is needed.
    """
    sets = (
        splits.filter(F.col("split") == "test")
        .groupBy("id")
        .agg(F.array_sort(F.collect_set("seed")).alias("seeds"))
    )
    first = sets.select("seeds", F.explode("seeds").alias("seed_a"))
    pairs = first.select(
        "seed_a", F.explode(F.filter("seeds", lambda s: s >= F.col("seed_a"))).alias("seed_b")
    )
    counts = pairs.groupBy("seed_a", "seed_b").agg(F.count("*").alias("n_shared"))
    size = F.max(F.when(F.col("seed_a") == F.col("seed_b"), F.col("n_shared")))
    sized = counts.withColumn("n_test_a", size.over(W.partitionBy("seed_a")))
    return sized.filter(F.col("seed_a") < F.col("seed_b")).withColumn(
        "shared_share", ratio("n_shared", "n_test_a")
    )


def leave_one_seed(metrics: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Range of the means obtained when each seed is left out in turn."""
    w = W.partitionBy(*by)
    rest = ratio(
        F.sum("value").over(w) - F.col("value"), F.count("value").over(w) - 1
    )
    return (
        metrics.filter(F.col("value").isNotNull())
        .withColumn("_rest", rest)
        .groupBy(*by)
        .agg(
            F.min("_rest").alias("min_mean"),
            F.max("_rest").alias("max_mean"),
            (F.max("_rest") - F.min("_rest")).alias("range"),
        )
    )
