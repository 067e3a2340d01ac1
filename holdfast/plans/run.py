"""One preserved run: every step of the evaluation is written and later steps read it.

Preprocessing is fitted on training rows inside the run, and the run writes its own log,
manifest and provenance, so that audits and traces read what happened and not a copy.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.audit import (
    audit_all,
    audit_balance,
    audit_complete,
    audit_order,
    audit_overlap,
    audit_params,
    audit_shares,
    audit_test,
)
from holdfast.operators.balance import even_copies
from holdfast.operators.metrics import evaluate
from holdfast.operators.model import fit_gnb_copies, score_gnb
from holdfast.operators.provenance import fingerprint
from holdfast.operators.split import freeze, plan_holdout
from holdfast.operators.transform import apply_params, apply_select, fit_impute, fit_scale, fit_select
from holdfast.plans.evaluation import SEEDS, STRATEGIES, sides
from holdfast.sources import sinks

# The order of a run with preprocessing; `audit_order` takes it as `steps`.
RUN_STEPS = ("split", "freeze", "prepare", "balance", "fit", "predict", "evaluate")


@dataclass(frozen=True)
class Run:
    """What a run left behind, read back from its folder."""

    seeds: tuple[int, ...]
    features: tuple[str, ...]
    k: int
    cohort: DataFrame
    splits: DataFrame
    params: DataFrame
    train_set: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    log: DataFrame
    claims: DataFrame
    provenance: DataFrame
    manifest: DataFrame


def fit_preparation(train: DataFrame, features: Sequence[str], k: int, groups: int) -> DataFrame:
    """Mean fill, z-scale of the filled values and the k features most correlated with y.

    All of it in one long table `(seed, transform, feature, stat, value, rank)`.
    """
    fill = fit_impute(train, features, "mean", groups=groups)
    filled = apply_params(train, fill, features, groups=groups).select(*train.columns)
    scale = fit_scale(filled, features, "z", groups=groups)
    scaled = apply_params(filled, scale, features, groups=groups).select(*train.columns)
    both = fill.unionByName(scale).withColumn("rank", F.lit(None).cast("int"))
    return both.unionByName(fit_select(scaled, features, k))


def apply_preparation(rows: DataFrame, params: DataFrame, features: Sequence[str], groups: int) -> DataFrame:
    """Fill, scale and select with the parameters of `fit_preparation`."""
    done = apply_params(rows, params.filter("transform <> 'select'"), features, groups=groups).select(*rows.columns)
    return apply_select(done, params.filter("transform = 'select'"), features, groups=groups)


def evaluate_run(
    cohort: DataFrame,
    features: Sequence[str],
    experiment: str,
    path: str,
    k: int,
    seeds: Sequence[int] = SEEDS,
    inputs: dict[str, DataFrame] | None = None,
) -> Run:
    """Run all seeds and both training strategies, keeping each step under `path`.

    `inputs` are the tables the cohort was made from; their fingerprints go into the
    manifest (without them, the fingerprint of the cohort).
    """
    spark = cohort.sparkSession
    features, n, config = list(features), len(seeds), f"frac=0.2;impute=mean;scale=z;select=pearson:{k}"
    log: list[tuple] = []

    def step(name: str, work: Callable):
        start = datetime.now(timezone.utc)
        made = work()
        for at in (start, datetime.now(timezone.utc)):
            log.extend((experiment, int(s), name, len(log), at) for s in seeds)
        return made

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    plan = step("split", lambda: plan_holdout(cohort, seeds))
    splits = step("freeze", lambda: freeze(plan.apply(cohort, features), f"{path}/splits"))
    train, test = sides(splits)
    params = step("prepare", lambda: kept(fit_preparation(train, features, k, n), "params"))
    ready = lambda rows: apply_preparation(rows, params, features, n)
    train_set = step("balance", lambda: kept(even_copies(ready(train), 2 * n, plan.train_sizes()), "train"))
    model = step("fit", lambda: kept(fit_gnb_copies(train_set, features, 2 * n), "model"))
    predictions = step(
        "predict",
        lambda: sinks.write_predictions(score_gnb(ready(test), model, features, experiment, groups=2 * n), f"{path}/predictions"),
    )
    metrics = step("evaluate", lambda: sinks.write_results(evaluate(predictions), "repeated_holdout", f"{path}/results"))
    prints = [f"{name}:{fingerprint(df).first()['fingerprint']}" for name, df in (inputs or {"cohort": cohort}).items()]
    manifest = sinks.append_manifest(
        sinks.manifest_rows(metrics, "repeated_holdout", config, ";".join(prints)), f"{path}/manifest"
    )
    claim = F.concat_ws(":", "experiment", "model", "strategy", F.col("seed").cast("string"), "metric")
    claims = metrics.select(claim.alias("claim_id"), "experiment", "model", "strategy", "seed", "metric", "value")
    links = claims.join(F.broadcast(manifest.select("experiment", "seed", "result_id")), ["experiment", "seed"])
    provenance = kept(links.select("claim_id", "result_id", F.concat(F.lit("table "), "metric").alias("figure")), "provenance")
    steps = spark.createDataFrame(log, "experiment string, seed int, step string, step_no int, at timestamp")
    return Run(
        tuple(seeds), tuple(features), k, cohort, splits, params, train_set, predictions, metrics, kept(steps, "log"),
        claims, provenance, manifest,
    )


def audit_run(run: Run) -> dict[str, DataFrame]:
    """The leakage checks over what a run kept; each holds violations only."""
    train, test = sides(run.splits)
    features, n = list(run.features), len(run.seeds)
    copies = run.train_set.withColumn("strategy", F.lit(STRATEGIES[1]))
    keys = ["seed", "transform", "feature", "stat"]
    everything = run.splits.drop("split")
    return {
        "overlap": audit_overlap(run.splits),
        "complete": audit_complete(run.splits, run.cohort, run.seeds),
        "test": audit_test(test, run.cohort, ["y", *features]),
        "balance": audit_balance(copies, run.splits),
        "params": audit_params(
            run.params, fit_preparation(train, features, run.k, n), fit_preparation(everything, features, run.k, n), keys=keys
        ),
        "order": audit_order(run.log, RUN_STEPS),
        "shares": audit_shares(run.splits),
    }


def audit_summary(run: Run) -> DataFrame:
    return audit_all(audit_run(run))
