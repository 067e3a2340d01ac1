"""Paired tests over seeds, for every (experiment, model, metric) in one aggregate.

Differences are rounded to twelve places first: floating noise would otherwise break
ties between equal differences. A group holds one row per seed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.functions.expr import normal_p, ratio, student_t_p
from holdfast.operators.primitives import join_small
from holdfast.operators.stability import PAIR_BY


def _moments(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    d = F.round("diff", 12)
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(d).alias("_mean"), F.stddev_samp(d).alias("_sd")
    )


def _t_rows(moments: DataFrame, by: Sequence[str], name: str, factor: Column) -> DataFrame:
    spread = F.when(F.col("_sd") > 0, F.col("_sd"))
    t = F.col("_mean") / (spread * F.sqrt(factor))
    return (
        moments.withColumn("statistic", t)
        .withColumn("_df", (F.col("n") - 1).cast("int"))
        .select(
            *by,
            F.lit(name).alias("test"),
            "n",
            "statistic",
            F.when(F.col("statistic").isNotNull(), student_t_p(F.col("statistic"), F.col("_df"))).alias("p_value"),
        )
    )


def paired_t(pairs: DataFrame, by: Sequence[str] = PAIR_BY) -> DataFrame:
    """Two-sided paired t with n - 1 degrees of freedom; null when the SD is 0."""
    return _t_rows(_moments(pairs, by), by, "paired_t", ratio(F.lit(1), F.col("n")))


def corrected_t(
    pairs: DataFrame, sizes: DataFrame, by: Sequence[str] = PAIR_BY, groups: int | None = 1
) -> DataFrame:
    """Paired t with variance x (1/J + n_test/n_train) (Nadeau and Bengio 2003).

    `sizes` is `(experiment, n_train, n_test)`, one row per experiment.
    """
    moments = join_small(_moments(pairs, by), sizes, ["experiment"], rows=groups)
    factor = ratio(F.lit(1), F.col("n")) + ratio("n_test", "n_train")
    return _t_rows(moments, by, "corrected_t", factor)


def split_sizes(splits: DataFrame, experiment: str) -> DataFrame:
    """Average train and test sizes over seeds, as `corrected_t` wants them."""
    per_seed = splits.groupBy("seed").agg(
        F.count_if(F.col("split") == "train").alias("a"), F.count_if(F.col("split") == "test").alias("b")
    )
    return per_seed.agg(F.avg("a").alias("n_train"), F.avg("b").alias("n_test")).select(
        F.lit(experiment).alias("experiment"), "n_train", "n_test"
    )


def wilcoxon(pairs: DataFrame, by: Sequence[str] = PAIR_BY) -> DataFrame:
    """Signed rank: zeros dropped, mid-ranks, normal approximation, no correction."""
    by = list(by)
    d = F.round("diff", 12)
    size = F.abs(F.col("_d"))
    ranked = (
        pairs.withColumn("_d", d)
        .withColumn("_zero", F.col("_d") == 0)
        .withColumn("_size", size)
        .withColumn(
            "_rank",
            F.rank().over(W.partitionBy(*by, "_zero").orderBy("_size"))
            + (F.count("*").over(W.partitionBy(*by, "_zero", "_size")) - 1) / 2,
        )
    )
    used = ~F.col("_zero")
    sums = ranked.groupBy(*by).agg(
        F.count_if(used).alias("n"),
        F.coalesce(F.sum(F.when(used & (F.col("_d") > 0), F.col("_rank"))), F.lit(0.0)).alias("_up"),
        F.coalesce(F.sum(F.when(used & (F.col("_d") < 0), F.col("_rank"))), F.lit(0.0)).alias("_down"),
        F.coalesce(F.sum(F.when(used, F.col("_rank") * F.col("_rank"))), F.lit(0.0)).alias("_sq"),
    )
    w = F.least("_up", "_down")
    n = F.col("n").cast("double")
    z = ratio(F.abs(w - n * (n + 1) / 4), F.sqrt(F.col("_sq") / 4))
    return sums.select(
        *by,
        F.lit("wilcoxon").alias("test"),
        "n",
        F.when(F.col("n") > 0, w).alias("statistic"),
        normal_p(z).alias("p_value"),
    )


def verdict(tests: DataFrame, pairs: DataFrame, alpha: float = 0.05, by: Sequence[str] = PAIR_BY) -> DataFrame:
    """"no supported difference" unless p < alpha, with direction and size alongside."""
    size = pairs.groupBy(*by).agg(F.avg("diff").alias("mean_diff"))
    way = F.signum(F.round("mean_diff", 12))
    return tests.join(size, list(by)).select(
        *by,
        "test",
        "p_value",
        "mean_diff",
        F.when(way > 0, "up").when(way < 0, "down").otherwise("none").alias("direction"),
        F.when(F.col("p_value") < alpha, "difference supported")
        .otherwise("no supported difference")
        .alias("verdict"),
    )
