"""Subgroup fairness on test predictions: per seed first, then over seeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.functions.expr import ratio
from holdfast.operators.model import KEYS
from holdfast.operators.stability import paired, summarize

GROUP = [*KEYS, "attr", "grp"]
COUNTS = ["n", "pos", "pred_pos", "tp"]
FAIR_BY = ["experiment", "model", "attr", "grp", "measure"]


def _level(attr: str) -> str:
    """SQL for the group of an attribute value; different values, null included, are different groups."""
    value = f"cast(`{attr}` as string)"
    return f"CASE WHEN {value} IS NULL THEN 'missing' WHEN {value} RLIKE '^=*missing$' THEN concat('=', {value}) ELSE {value} END"


def subgroups(
    pred: DataFrame,
    attrs: Sequence[str],
    cohort: DataFrame | None = None,
    reference: Mapping[str, str] | None = None,
) -> DataFrame:
    """Counts per attribute group and for its comparator (`rest_*`).

    The comparator is the rest of the rows, or the named reference group of the
    attribute. Attributes come with the predictions, or from `cohort` by id. Null
    attribute values form the group `missing`; a level of that very name is `=missing`.
    """
    if cohort is not None:
        pred = pred.join(cohort.select("id", *attrs), "id", "left")
    args = ", ".join(f"'{a}', {_level(a)}" for a in attrs)
    long = pred.select(*KEYS, "y", "y_pred", F.expr(f"stack({len(attrs)}, {args}) as (attr, grp)"))
    y, p = F.col("y"), F.col("y_pred")
    counts = long.groupBy(*GROUP).agg(
        F.count("*").alias("n"),
        F.count_if(y == 1).alias("pos"),
        F.count_if(p == 1).alias("pred_pos"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )
    whole = W.partitionBy(*KEYS, "attr")
    named = F.create_map(*[F.lit(x) for kv in reference.items() for x in kv]) if reference else None

    def rest(c: str) -> Column:
        others = F.sum(c).over(whole) - F.col(c)
        if named is None:
            return others
        ref = F.get(F.array(F.try_element_at(named, F.col("attr"))), F.lit(0))
        fixed = F.max(F.when(F.col("grp") == ref, F.col(c))).over(whole)
        return F.when(ref.isNull(), others).otherwise(fixed)

    return counts.withColumns({f"rest_{c}": rest(c) for c in COUNTS})


def _measures() -> dict[str, Column]:
    rate, other = ratio("pred_pos", "n"), ratio("rest_pred_pos", "rest_n")
    return {
        "spd": rate - other,
        "eod": ratio("tp", "pos") - ratio("rest_tp", "rest_pos"),
        "di": F.try_divide(rate, other),
    }


def fairness(sub: DataFrame, measures: Sequence[str] = ("spd", "eod", "di")) -> DataFrame:
    """Long `(keys, attr, grp, n, prevalence, measure, value)`."""
    cols = {m: _measures()[m] for m in measures}
    args = ", ".join(f"'{m}', `{m}`" for m in cols)
    return (
        sub.withColumns({**cols, "prevalence": ratio("pos", "n")})
        .select(*GROUP, "n", "prevalence", F.expr(f"stack({len(cols)}, {args}) as (measure, value)"))
    )


def spd(sub: DataFrame) -> DataFrame:
    """Statistical parity difference: selection rate minus the comparator's."""
    return fairness(sub, ["spd"])


def eod(sub: DataFrame) -> DataFrame:
    """Equal opportunity difference (Hardt et al. 2016); null without positives."""
    return fairness(sub, ["eod"])


def di(sub: DataFrame) -> DataFrame:
    """Disparate impact (Feldman et al. 2015); null on a zero comparator rate."""
    return fairness(sub, ["di"])


def fairness_summary(fair: DataFrame) -> DataFrame:
    """Mean and sample SD over seeds, with the number of seeds where it is defined."""
    return summarize(fair, ["experiment", "model", "strategy", "attr", "grp", "measure"])


def subgroup_caution(sub: DataFrame, min_n: int = 30, z: float = 1.96) -> DataFrame:
    """Wilson intervals on selection and true positive rate, and a small-group flag."""

    def wilson(hit: str, n: str) -> tuple[Column, Column]:
        k, m = F.col(hit).cast("double"), F.col(n).cast("double")
        p = ratio(k, m)
        mid = F.try_divide(k + z * z / 2, m + z * z)
        half = F.try_divide(
            z * F.sqrt(m * p * (1 - p) + z * z / 4), m + z * z
        )
        return F.when(m > 0, mid - half), F.when(m > 0, mid + half)

    rate, tpr = wilson("pred_pos", "n"), wilson("tp", "pos")
    return sub.select(
        *GROUP,
        "n",
        ratio("pos", "n").alias("prevalence"),
        ratio("pred_pos", "n").alias("rate"),
        rate[0].alias("rate_low"),
        rate[1].alias("rate_high"),
        ratio("tp", "pos").alias("tpr"),
        tpr[0].alias("tpr_low"),
        tpr[1].alias("tpr_high"),
        (F.col("n") < min_n).alias("small_group"),
    )


def fairness_paired(fair: DataFrame, a: str, b: str) -> DataFrame:
    """Per-seed change of each measure from strategy a to strategy b."""
    return paired(fair, a, b, by=FAIR_BY)
