"""The tables behind the figures: box statistics, ROC curves, subgroup bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.fairness import fairness_summary
from holdfast.operators.metrics import roc_points
from holdfast.operators.stability import BY


def figure_data(kind: str, source: DataFrame) -> DataFrame:
    """`box` reads metrics, `roc` predictions, `bars` fairness values."""
    if kind == "box":
        p = lambda q: F.expr(f"percentile(value, {q}D)")
        iqr = F.col("q3") - F.col("q1")
        stats = source.groupBy(*BY).agg(
            p(0.25).alias("q1"), p(0.5).alias("median"), p(0.75).alias("q3"), F.collect_list("value").alias("_v")
        )
        inside = F.filter("_v", lambda v: (v >= F.col("q1") - 1.5 * iqr) & (v <= F.col("q3") + 1.5 * iqr))
        return stats.withColumn("_in", inside).select(
            *BY,
            F.array_min("_in").alias("whisker_low"),
            "q1",
            "median",
            "q3",
            F.array_max("_in").alias("whisker_high"),
            (F.size("_v") - F.size("_in")).alias("n_outliers"),
        )
    if kind == "roc":
        return roc_points(source)
    if kind == "bars":
        return fairness_summary(source).select(
            "experiment", "model", "strategy", "attr", "grp", "measure", "mean", "sd", "n_seeds"
        )
    raise ValueError(f"unknown figure {kind!r}")
