"""The evaluation end to end, as one lazy plan; `run.py` keeps every step of it as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.balance import even_copies
from holdfast.operators.metrics import evaluate
from holdfast.operators.model import fit_gnb_copies, score_gnb
from holdfast.operators.split import plan_holdout
from holdfast.operators.stability import summarize

SEEDS = tuple(range(1, 11))
STRATEGIES = ("unbalanced", "oversampled")


def sides(sided: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        sided.filter(F.col("split") == "train").drop("split"),
        sided.filter(F.col("split") == "test").drop("split"),
    )


def gnb_predictions(
    cohort: DataFrame,
    features: Sequence[str],
    experiment: str,
    seeds: Sequence[int] = SEEDS,
    keep: Sequence[str] = (),
    entity: str | None = None,
) -> DataFrame:
    """Split, balance the training side, fit and score the test side, for all seeds."""
    plan = plan_holdout(cohort, seeds, entity=entity)
    train, test = sides(plan.apply(cohort, [*features, *keep]))
    copies = even_copies(train, 2 * len(seeds), plan.train_sizes())
    params = fit_gnb_copies(copies, features, groups=2 * len(seeds))
    return score_gnb(test, params, features, experiment, groups=2 * len(seeds), keep=keep)


def gnb_metrics(cohort: DataFrame, features: Sequence[str], experiment: str, seeds: Sequence[int] = SEEDS) -> DataFrame:
    return evaluate(gnb_predictions(cohort, features, experiment, seeds))


def repeated_holdout_summary(
    cohort: DataFrame, features: Sequence[str], experiment: str, seeds: Sequence[int] = SEEDS
) -> DataFrame:
    """Mean and spread of every metric, per strategy."""
    return summarize(gnb_metrics(cohort, features, experiment, seeds))
