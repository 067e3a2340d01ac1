"""Point metrics and ranking metrics from test predictions.

Ranking never sorts a whole group in one task. Scores are rounded to six places, so a
unit-wide bucket holds at most a million distinct scores; each bucket is folded to
(positives, negatives, rank sum), and folds of neighbouring buckets combine by
(P1+P2, N1+N2, U1+U2+P2*N1).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.functions.expr import ratio
from holdfast.operators.model import KEYS
from holdfast.operators.primitives import prefix_sum

COUNTS = ["tp", "fp", "fn", "tn"]


def _cell(y: int, pred: int) -> Column:
    return (F.col("y") == y) & (F.col("y_pred") == pred)


def confusion(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return pred.groupBy(*keys).agg(
        F.count_if(_cell(1, 1)).alias("tp"),
        F.count_if(_cell(0, 1)).alias("fp"),
        F.count_if(_cell(1, 0)).alias("fn"),
        F.count_if(_cell(0, 0)).alias("tn"),
    )


def _point_columns() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in COUNTS)
    zero = F.lit(0.0)
    return {
        "accuracy": F.coalesce(ratio(tp + tn, tp + fp + fn + tn), zero),
        "precision": F.coalesce(ratio(tp, tp + fp), zero),
        "recall": F.coalesce(ratio(tp, tp + fn), zero),
        "f1": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero),
    }


def _to_long(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    args = ", ".join(f"'{n}', `{n}`" for n in names)
    return df.select(*keys, F.expr(f"stack({len(names)}, {args}) as (metric, value)"))


def point_metrics(conf: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Accuracy, precision, recall and binary F1 as long rows; 0/0 is 0."""
    cols = _point_columns()
    return _to_long(conf.withColumns(cols), keys, list(cols))


def score_counts(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts per distinct rounded score; equal scores collapse before the shuffle.

    Rows without a score rank nowhere: they count for the confusion cells only.
    """
    rows = pred.select(*keys, "y", "y_pred", F.round("score", 6).alias("score"))
    ranked = F.col("score").isNotNull().cast("bigint")
    return rows.groupBy(*keys, F.floor("score").alias("bucket"), "score").agg(
        F.sum(F.col("y").cast("bigint") * ranked).alias("pos"),
        F.sum((1 - F.col("y").cast("bigint")) * ranked).alias("neg"),
        F.count_if(_cell(1, 1)).alias("tp"),
        F.count_if(_cell(0, 1)).alias("fp"),
        F.count_if(_cell(1, 0)).alias("fn"),
        F.count_if(_cell(0, 0)).alias("tn"),
    )


def _folded(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group: P, N, U and the confusion counts."""
    keys = list(keys)
    sums = [F.sum(c).alias(c) for c in COUNTS]

    def before(part: list[str], order: str, n: str) -> Column:
        w = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(n).over(w), F.lit(0)).cast("double")

    part = [*keys, "bucket"]
    rank = F.col("pos") * (before(part, "score", "neg") + F.col("neg") / 2)
    level = (
        score_counts(pred, keys)
        .withColumn("_u", rank)
        .groupBy(*part)
        .agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum("_u").alias("u"), *sums)
        .withColumn("_wide", F.floor(F.col("bucket") / 1_000_000))
    )
    for part, order in (([*keys, "_wide"], "bucket"), (keys, "_wide")):
        level = (
            level.withColumn("u", F.col("u") + F.col("p") * before(part, order, "n"))
            .groupBy(*part)
            .agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("u").alias("u"), *sums)
        )
    return level


def _auc() -> Column:
    return ratio(F.col("u"), F.col("p").cast("double") * F.col("n").cast("double"))


def roc_auc(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """`(keys..., roc_auc)` with mid-ranks for ties; null when a class is absent."""
    return _folded(pred, keys).select(*keys, _auc().alias("roc_auc"))


def evaluate(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All metrics as long rows out of one pass over the predictions."""
    cols = {**_point_columns(), "roc_auc": _auc()}
    return _to_long(_folded(pred, keys).withColumns(cols), keys, list(cols))


def roc_points(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(fpr, tpr) when everything scoring at least `score` is called positive."""
    keys = list(keys)
    counts = score_counts(pred, keys).withColumn("_down", -F.col("bucket"))
    cum = prefix_sum(counts, keys, "_down", [F.desc("score")], {"pos": "_tp", "neg": "_fp"})
    totals = counts.groupBy(*keys, "_down").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    whole = W.partitionBy(*keys)
    totals = totals.select(
        *keys, "_down", F.sum("_p").over(whole).alias("_p"), F.sum("_n").over(whole).alias("_n")
    )
    return cum.join(totals, [*keys, "_down"]).select(
        *keys, "score", ratio("_fp", "_n").alias("fpr"), ratio("_tp", "_p").alias("tpr")
    )
