"""Cohort preparation: cleaning, criteria, target, predictors, release gate, profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from holdfast.functions.expr import ratio


@dataclass(frozen=True)
class Rule:
    """How one column is cleaned: trim, lower-case, sentinel strings to null, cast."""

    trim: bool = True
    lower: bool = False
    sentinels: tuple[str, ...] = ()
    cast: str | None = None

    def apply(self, col: Column) -> Column:
        out = col.cast("string")
        if self.trim:
            out = F.trim(out)
        if self.lower:
            out = F.lower(out)
        if self.sentinels:
            out = F.when(~out.isin(*self.sentinels), out)
        return out.try_cast(self.cast) if self.cast else out


def clean(df: DataFrame, rules: Mapping[str, Rule], ident: str | None = None) -> DataFrame:
    """Apply the rules, then drop exact duplicate rows.

    With `ident` rows are duplicates when all other columns agree, and the smallest
    identifier stays. Copies collapse map-side, so a large group of them is cheap.
    """
    out = df.withColumns({c: r.apply(F.col(c)) for c, r in rules.items()})
    if ident is None:
        return out.dropDuplicates()
    content = [c for c in out.columns if c != ident]
    return out.groupBy(*content).agg(F.min(ident).alias(ident)).select(*df.columns)


def _first_failing(criteria: Sequence[tuple[str, str]]) -> Column:
    step = F.lit(None).cast("int")
    for i in range(len(criteria), 0, -1):
        step = F.when(~F.coalesce(F.expr(criteria[i - 1][1]), F.lit(False)), i).otherwise(step)
    return step


def apply_criteria(df: DataFrame, criteria: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Ordered inclusion criteria; returns the kept rows and the attrition table.

    A null criterion excludes. Attrition is one aggregate over the first failing step:
    `(step, criterion, n_excluded, n_left)`.
    """
    failing = _first_failing(criteria)
    steps = F.array(
        *[F.struct(F.lit(i).alias("step"), F.lit(name).alias("criterion")) for i, (name, _) in enumerate(criteria, 1)]
    )
    counts = df.groupBy(failing.alias("_fail")).agg(F.count("*").alias("_n"))
    table = (
        counts.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("_all"),
            F.map_from_entries(
                F.collect_list(F.when(F.col("_fail").isNotNull(), F.struct("_fail", "_n")))
            ).alias("_by"),
        )
        .select("_all", "_by", F.explode(steps).alias("_s"))
        .select(
            F.col("_s.step").alias("step"),
            F.col("_s.criterion").alias("criterion"),
            F.coalesce(F.try_element_at("_by", F.col("_s.step")), F.lit(0)).alias("n_excluded"),
            "_all",
        )
    )
    out = F.sum("n_excluded").over(W.orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    attrition = table.withColumn("n_left", F.col("_all") - out).drop("_all")
    return df.filter(failing.isNull()), attrition


def with_target(df: DataFrame, expr: str) -> DataFrame:
    return df.withColumn("y", F.expr(expr).cast("int"))


def with_features(df: DataFrame, exprs: Mapping[str, str], keep: Sequence[str] = ("id", "y")) -> DataFrame:
    return df.select(*keep, *[F.expr(e).alias(name) for name, e in exprs.items()])


def release_view(df: DataFrame, approvals: DataFrame, allow: Sequence[str], dataset: str = "dataset") -> DataFrame:
    """Rows of approved datasets, allow-listed columns only.

    `approvals` is `(dataset, approved)`; a dataset without an approval is not released.
    """
    approved = approvals.filter("approved").select(dataset)
    return df.join(approved, dataset, "left_semi").select(*allow)


# Patterns in the syntax Java and RE2 share.
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9]{1,3}[ .-][0-9]{3}[ .-][0-9]{3,4}[ .-]?[0-9]{0,4}",
    "id_number": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}


def pii_scan(df: DataFrame, cols: Sequence[str], patterns: Mapping[str, str] = PII_PATTERNS) -> DataFrame:
    """Per (column, pattern) the rows that match: one map-side aggregate over whole texts."""
    cells = [(c, p) for c in cols for p in patterns]
    counts = df.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col(c).rlike(patterns[p])).alias(f"{c}~{p}") for c, p in cells],
    )
    args = ", ".join(f"'{c}', '{p}', `{c}~{p}`" for c, p in cells)
    return counts.select(
        F.expr(f"stack({len(cells)}, {args}) as (col, pattern, n_hits)"), "n_rows"
    ).select("col", "pattern", "n_rows", "n_hits", ratio("n_hits", "n_rows").alias("share"))


def profile(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Per variable: type, rows, missing share, distinct values, min, max, mean.

    min, max and mean are for numeric variables; a 0/1 target shows its class share as
    the mean. `approx` counts distinct values with a sketch, which saves the shuffle of
    one row per distinct value and column.
    """
    cols = list(cols or df.columns)
    numeric = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    aggs = [F.count("*").alias("_n")]
    for c in cols:
        distinct = F.approx_count_distinct(c) if approx else F.count_distinct(F.col(c))
        aggs += [F.count(c).alias(f"c_{c}"), distinct.alias(f"d_{c}")]
    for c in numeric:
        aggs += [
            F.min(c).cast("double").alias(f"lo_{c}"),
            F.max(c).cast("double").alias(f"hi_{c}"),
            F.avg(c).cast("double").alias(f"m_{c}"),
        ]
    null = "cast(null as double)"
    rows = []
    for c in cols:
        stats = f"`lo_{c}`, `hi_{c}`, `m_{c}`" if c in numeric else f"{null}, {null}, {null}"
        kind = "numeric" if c in numeric else "categorical"
        rows.append(f"'{c}', '{kind}', `c_{c}`, `d_{c}`, {stats}")
    names = "(variable, kind, _c, n_distinct, min, max, mean)"
    long = df.agg(*aggs).select("_n", F.expr(f"stack({len(cols)}, {', '.join(rows)}) as {names}"))
    return long.select(
        "variable",
        "kind",
        F.col("_n").alias("n_rows"),
        ratio(F.col("_n") - F.col("_c"), F.col("_n")).alias("missing_share"),
        "n_distinct",
        "min",
        "max",
        "mean",
    )
