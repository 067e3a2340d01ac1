"""Logistic regression for every (seed, strategy, penalty) at once.

A round of Newton's method is one aggregate over the training rows, which gives the loss,
the gradient and the Hessian of all groups; the small solves happen in the driver on a
few numbers a group. Rows meet the coefficients map-side, so no row is shuffled, and the
number of jobs follows the rounds of the slowest group, not the number of fits. The
aggregate is as wide as the square of the features, so this is for tens of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.operators.model import label_scores
from holdfast.operators.primitives import BROADCAST_ROWS, join_small, settle

HALVINGS = 30
CONST = "const"


@dataclass
class _Fit:
    """One group between rounds: where it stands, where it goes, how far."""

    beta: np.ndarray
    loss: float = np.inf
    at: np.ndarray | None = None
    step: np.ndarray | None = None
    halved: int = 0
    gradient: float = np.inf
    rounds: int = 0
    done: bool = False

    def advance(self, loss: float, gradient: np.ndarray, hessian: np.ndarray, tol: float) -> None:
        self.rounds += 1
        if self.at is not None and loss > self.loss + 1e-12 and self.halved < HALVINGS:
            self.halved += 1
            self.step = self.step / 2
            self.beta = self.at + self.step
            return
        self.loss, self.at, self.halved = loss, self.beta, 0
        self.gradient = float(np.abs(gradient).max())
        if self.gradient <= tol:
            self.done = True
            return
        self.step = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        self.beta = self.at + self.step


def fit_logistic(
    train: DataFrame,
    features: Sequence[str],
    groups: int,
    penalties: Sequence[float] = (1e-3,),
    rounds: int = 50,
    tol: float = 1e-9,
) -> DataFrame:
    """One row per (seed, strategy, penalty): scales, coefficients, rounds and last gradient.

    `train` holds `seed, y` and the features; with `copies` (see `even_copies`) both
    strategies are fitted, copies being weights, else the unbalanced one. `groups` bounds
    the number of (seed, strategy) pairs, more is an error. The mean loss of a group plus half of
    `penalty` times the squared coefficients of the standardised features is
    minimised; the constant is not penalised. A missing or non-finite value counts as
    the group's mean; a constant feature has coefficient 0. Standard deviations are those
    of a sample. Where training lacks a class the coefficients are null. `gradient` is
    the largest entry of the gradient, `tol` or less where the fit has converged; classes
    that separate have no optimum at penalty 0, their fit stops when the gradient is flat.
    """
    if groups * len(penalties) > BROADCAST_ROWS:
        raise ValueError(f"{groups} groups of {len(penalties)} penalties are too many for one fit")
    rows = settle(_arms(train, features))
    scales = settle(_scales(rows, features, groups), groups)
    kept = [f.name for f in scales.schema]
    arms = [row.asDict() for row in scales.collect()]
    fits: dict[tuple, _Fit] = {}
    for a in arms:
        if a["n0"] > 0 and a["n1"] > 0:
            start = np.zeros(len(features) + 1)
            start[0] = np.log(a["n1"] / a["n0"])
            fits |= {(a["seed"], a["strategy"], float(p)): _Fit(start.copy()) for p in penalties}

    by_arm = {(a["seed"], a["strategy"]): a for a in arms}
    names = [CONST, *features]
    schema = T.StructType(
        [
            *scales.schema.fields,
            T.StructField("penalty", T.DoubleType()),
            *[T.StructField(f"b_{n}", T.DoubleType()) for n in names],
        ]
    )
    spark = train.sparkSession
    for _ in range(rounds):
        live = {k: f for k, f in fits.items() if not f.done}
        if not live:
            break
        table = spark.createDataFrame(
            [(*[by_arm[k[:2]][c] for c in kept], k[2], *f.beta.tolist()) for k, f in live.items()], schema
        )
        sums = join_small(rows, table, ["seed", "strategy"], rows=len(live))
        for row in sums.groupBy("seed", "strategy", "penalty").agg(*_derivatives(features)).collect():
            key = (row["seed"], row["strategy"], row["penalty"])
            fit, ridge = live[key], np.full(len(names), key[2])
            ridge[0] = 0.0
            gradient = np.array([row[f"g{i}"] for i in range(len(names))]) + ridge * fit.beta
            hessian = np.diag(ridge)
            for i in range(len(names)):
                for j in range(i + 1):
                    hessian[i, j] += row[f"h{i}_{j}"]
                    hessian[j, i] = hessian[i, j]
            fit.advance(row["loss"] + float(ridge @ fit.beta**2) / 2, gradient, hessian, tol)

    out = []
    for a in arms:
        for p in penalties:
            fit = fits.get((a["seed"], a["strategy"], float(p)))
            beta = [None] * len(names) if fit is None else (fit.beta if fit.at is None else fit.at).tolist()
            last = (0, None) if fit is None else (fit.rounds, fit.gradient)
            out.append((*[a[c] for c in kept], float(p), *beta, *last))
    more = [T.StructField("rounds", T.IntegerType()), T.StructField("gradient", T.DoubleType())]
    return spark.createDataFrame(out, T.StructType([*schema.fields, *more]))


def coefficients(params: DataFrame, features: Sequence[str]) -> DataFrame:
    """`(seed, strategy, penalty, feature, coef)`, of standardised features; the constant is `const`."""
    pairs = [F.struct(F.lit(n).alias("feature"), F.col(f"b_{n}").alias("coef")) for n in (CONST, *features)]
    long = params.select("seed", "strategy", "penalty", F.explode(F.array(*pairs)).alias("_p"))
    return long.select("seed", "strategy", "penalty", "_p.feature", "_p.coef")


def score_logistic(
    test: DataFrame,
    params: DataFrame,
    features: Sequence[str],
    experiment: str,
    groups: int,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Log-odds per (strategy, seed, id); label 1 when above 0, the class seen where training had one.

    `groups` bounds the rows of `params`. `keep` may name `penalty`, for a fit of several.
    """
    out = join_small(test, params, ["seed"], rows=groups)
    for f in features:
        out = out.withColumn(f, _finite(f))
    return label_scores(out, experiment, "logistic", _margin(features), keep)


def _finite(feature: str) -> Column:
    x = F.col(feature).cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def _arms(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Narrow training rows, one per strategy, with their weight `w`."""
    arms = [F.struct(F.lit("unbalanced").alias("strategy"), F.lit(1.0).alias("w"))]
    if "copies" in train.columns:
        arms.append(F.struct(F.lit("oversampled").alias("strategy"), F.col("copies").cast("double").alias("w")))
    rows = train.select("seed", "y", *[_finite(f).alias(f) for f in features], F.explode(F.array(*arms)).alias("_a"))
    return rows.select("seed", "_a.strategy", F.col("y").cast("double").alias("y"), "_a.w", *features)


def _scales(rows: DataFrame, features: Sequence[str], groups: int) -> DataFrame:
    """Weights per class and, per feature, mean `m_` and sample deviation `s_`."""
    w = F.col("w")
    means = settle(
        rows.groupBy("seed", "strategy").agg(
            F.sum(F.when(F.col("y") == 0, w).otherwise(0.0)).alias("n0"),
            F.sum(F.when(F.col("y") == 1, w).otherwise(0.0)).alias("n1"),
            *[
                F.coalesce(F.sum(w * F.col(f)) / F.sum(F.when(F.col(f).isNotNull(), w)), F.lit(0.0)).alias(f"m_{f}")
                for f in features
            ],
        ),
        groups,
    )
    off = {f: F.col(f) - F.col(f"m_{f}") for f in features}
    spread = join_small(rows, means, ["seed", "strategy"], rows=groups).groupBy("seed", "strategy").agg(
        *[
            F.sqrt(F.coalesce(F.sum(w * off[f] * off[f]), F.lit(0.0)) / F.greatest(F.sum(w) - 1, F.lit(1.0))).alias(f"s_{f}")
            for f in features
        ]
    )
    return join_small(means, spread, ["seed", "strategy"], rows=groups)


def _standard(feature: str) -> Column:
    z = (F.col(feature) - F.col(f"m_{feature}")) / F.col(f"s_{feature}")
    return F.coalesce(F.when(F.col(f"s_{feature}") > 0, z), F.lit(0.0))


def _margin(features: Sequence[str]) -> Column:
    total = F.col(f"b_{CONST}")
    for f in features:
        total = total + F.col(f"b_{f}") * _standard(f)
    return total


def _derivatives(features: Sequence[str]) -> list[Column]:
    """Mean loss, its gradient and the lower half of its Hessian, as sums over rows."""
    t, w = _margin(features), F.col("w") / (F.col("n0") + F.col("n1"))
    p = 1 / (1 + F.exp(-t))
    side = F.when(F.col("y") == 1, t).otherwise(-t)
    z = [F.lit(1.0), *[_standard(f) for f in features]]
    out = [F.sum(w * (F.log1p(F.exp(-F.abs(t))) + F.greatest(-side, F.lit(0.0)))).alias("loss")]
    for i, a in enumerate(z):
        out.append(F.sum(w * (p - F.col("y")) * a).alias(f"g{i}"))
        out += [F.sum(w * p * (1 - p) * a * b).alias(f"h{i}_{j}") for j, b in enumerate(z[: i + 1])]
    return out
