"""Transforms whose parameters come from training rows only.

Fitting returns long rows `(seed, strategy, transform, feature, stat, value)`, a size
set by the grid and the feature list; applying pivots them to one wide row per group
and joins that to any rows of the same group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.functions.expr import ratio
from holdfast.operators.metrics import confusion, point_metrics
from holdfast.operators.primitives import exact_percentiles, join_levels, join_small, prefix_sum, settle

BY = ["seed"]
SIDE_BY_SIDE = 32  # groups whose counts of a value lie in one row


def melt(df: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    args = ", ".join(f"'{f}', cast(`{f}` as double)" for f in features)
    return df.select(*by, F.expr(f"stack({len(features)}, {args}) as (feature, value)"))


def _wide_to_long(
    wide: DataFrame, by: Sequence[str], transform: str, features: Sequence[str], stats: Sequence[str]
) -> DataFrame:
    cells = [(f, s) for f in features for s in stats]
    args = ", ".join(f"'{f}', '{s}', cast(`{s}_{f}` as double)" for f, s in cells)
    return wide.select(
        *by, F.lit(transform).alias("transform"), F.expr(f"stack({len(cells)}, {args}) as (feature, stat, value)")
    )


def _labelled(df: DataFrame, by: Sequence[str], transform: str, stat: str) -> DataFrame:
    return df.select(*by, F.lit(transform).alias("transform"), "feature", F.lit(stat).alias("stat"), "value")


def fit_impute(
    train: DataFrame, features: Sequence[str], how: str = "mean", by: Sequence[str] = BY, groups: int | None = None
) -> DataFrame:
    """Fill value per feature: mean, median or mode (ties go to the smallest value)."""
    by = list(by)
    if how == "mean":
        wide = train.groupBy(*by).agg(*[F.avg(F.col(f).cast("double")).alias(f"fill_{f}") for f in features])
        return _wide_to_long(wide, by, "impute", features, ["fill"])
    if how == "median":
        return _labelled(exact_percentiles(train, by, features, [0.5], groups), by, "impute", "fill")
    if how == "mode":
        counts = _value_counts(train, by, features, groups)
        # the smallest value of each count, so that no task sorts or holds all values of a feature
        least = counts.groupBy(*by, "feature", "_n").agg(F.min("value").alias("value"))
        top = least.groupBy(*by, "feature").agg(
            F.min_by("value", F.struct((-F.col("_n")).alias("n"), F.col("value").alias("v"))).alias("value")
        )
        return _labelled(top, by, "impute", "fill")
    raise ValueError(f"unknown imputation {how!r}")


def _value_counts(train: DataFrame, by: list[str], features: Sequence[str], groups: int | None) -> DataFrame:
    """`(by..., feature, value, _n)` of all values but null.

    Groups share most of their rows (the training rows of every seed), so that few groups are
    counted side by side, in one entry per value instead of one per value and group.
    """
    values = melt(train, by, features).filter(F.col("value").isNotNull())
    known = train.select(*by).distinct().collect() if groups is not None and groups <= SIDE_BY_SIDE else []
    if not known or len(known) > SIDE_BY_SIDE:
        return values.groupBy(*by, "feature", "value").agg(F.count("*").alias("_n"))
    group = [[F.lit(r[b]).cast(train.schema[b].dataType) for b in by] for r in known]
    mine = [reduce(Column.__and__, [F.col(b).eqNullSafe(v) for b, v in zip(by, g)]) for g in group]
    counts = values.groupBy("feature", "value").agg(*[F.count_if(m).alias(f"_n{i}") for i, m in enumerate(mine)])
    each = [F.struct(*[v.alias(b) for b, v in zip(by, g)], F.col(f"_n{i}").alias("_n")) for i, g in enumerate(group)]
    found = counts.select("feature", "value", F.explode(F.array(*each)).alias("_g"))
    return found.select(*[F.col(f"_g.{b}").alias(b) for b in by], "feature", "value", "_g._n").filter("_n > 0")


def fit_scale(
    train: DataFrame, features: Sequence[str], how: str = "z", by: Sequence[str] = BY, groups: int | None = None
) -> DataFrame:
    """Centre and scale per feature: z-score, min-max or robust (median, IQR)."""
    by = list(by)
    if how == "robust":
        q = exact_percentiles(train, by, features, [0.25, 0.5, 0.75], groups)
        at = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
        wide = q.groupBy(*by, "feature").agg(at(0.5).alias("_c"), (at(0.75) - at(0.25)).alias("_s"))
        return wide.select(
            *by,
            F.lit("scale").alias("transform"),
            "feature",
            F.expr("stack(2, 'center', _c, 'scale', _s) as (stat, value)"),
        )
    aggs: list[Column] = []
    for f in features:
        x = F.col(f).cast("double")
        if how == "z":
            aggs += [F.avg(x).alias(f"center_{f}"), F.stddev_pop(x).alias(f"scale_{f}")]
        elif how == "minmax":
            aggs += [F.min(x).alias(f"center_{f}"), (F.max(x) - F.min(x)).alias(f"scale_{f}")]
        else:
            raise ValueError(f"unknown scaling {how!r}")
    return _wide_to_long(train.groupBy(*by).agg(*aggs), by, "scale", features, ["center", "scale"])


def fit_select(
    train: DataFrame, features: Sequence[str], k: int, score: str = "pearson", by: Sequence[str] = BY
) -> DataFrame:
    """Top k features per group by variance, |Pearson r| or ANOVA F.

    All scores of a group come from one wide aggregate; the ranking sees one row per
    feature. Constant features score 0.
    """
    by = list(by)
    y = F.col("y").cast("double")
    aggs = []
    for f in features:
        x = F.col(f).cast("double")
        if score == "variance":
            value = F.var_pop(x)
        elif score == "pearson":
            both = F.when(x.isNotNull(), y)
            moving = (F.stddev_pop(x) > 0) & (F.stddev_pop(both) > 0)
            value = F.when(moving, F.abs(F.try_divide(F.covar_pop(x, both), F.stddev_pop(x) * F.stddev_pop(both))))
        elif score == "anova":
            one, zero = F.when(F.col("y") == 1, x), F.when(F.col("y") == 0, x)
            n1, n0 = F.count(one).cast("double"), F.count(zero).cast("double")
            mean = F.avg(x)
            between = n1 * F.pow(F.avg(one) - mean, F.lit(2.0)) + n0 * F.pow(F.avg(zero) - mean, F.lit(2.0))
            within = n1 * F.var_pop(one) + n0 * F.var_pop(zero)
            value = F.try_divide(between * (n1 + n0 - 2), within)
        else:
            raise ValueError(f"unknown score {score!r}")
        aggs.append(F.coalesce(value, F.lit(0.0)).alias(f"score_{f}"))
    long = _wide_to_long(train.groupBy(*by).agg(*aggs), by, "select", features, ["score"])
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.round("value", 9)), "feature"))
    return long.withColumn("rank", rank).filter(F.col("rank") <= k)


def apply_params(
    df: DataFrame, params: DataFrame, features: Sequence[str], by: Sequence[str] = BY, groups: int | None = None
) -> DataFrame:
    """Fill, then centre and scale, with whatever parameters are given.

    Adds `<feature>_missing` where fill values are applied. Zero spread gives 0.0.
    """
    by = list(by)
    stats = {"impute": ["fill"], "scale": ["center", "scale"]}
    aggs = []
    for transform, names in stats.items():
        for f in features:
            for s in names:
                hit = (F.col("transform") == transform) & (F.col("feature") == f) & (F.col("stat") == s)
                aggs.append(F.max(F.when(hit, F.col("value"))).alias(f"_{s}_{f}"))
    for transform in stats:
        aggs.append(F.coalesce(F.max(F.col("transform") == transform), F.lit(False)).alias(f"_has_{transform}"))
    wide = settle(params.groupBy(*by).agg(*aggs), groups)
    out = join_small(df, wide, by, rows=groups)
    new = {}
    for f in features:
        x = F.col(f).cast("double")
        filled = F.coalesce(x, F.col(f"_fill_{f}"))
        spread = F.col(f"_scale_{f}")
        scaled = F.when(spread == 0, F.lit(0.0)).otherwise((filled - F.col(f"_center_{f}")) / F.nullif(spread, F.lit(0.0)))
        new[f] = F.when(F.col("_has_scale") & filled.isNotNull(), scaled).otherwise(filled)
        new[f"{f}_missing"] = F.when(F.col("_has_impute"), F.col(f).isNull().cast("int"))
    return out.withColumns(new).select(*df.columns, *[f"{f}_missing" for f in features])


def apply_select(
    df: DataFrame, selected: DataFrame, features: Sequence[str], by: Sequence[str] = BY, groups: int | None = None
) -> DataFrame:
    """Features that `fit_select` left out for a group become null in its rows.

    The columns stay the same for every group, and null adds nothing to a score.
    """
    by = list(by)
    kept = [F.max(F.col("feature") == f).alias(f"_keep_{f}") for f in features]
    wide = settle(selected.groupBy(*by).agg(*kept), groups)
    out = join_small(df, wide, by, "left", rows=groups)
    return out.withColumns({f: F.when(F.col(f"_keep_{f}"), F.col(f)) for f in features}).select(*df.columns)


def fit_encode(
    train: DataFrame,
    cols: Sequence[str],
    how: str = "ordinal",
    smooth: float = 10.0,
    by: Sequence[str] = BY,
    groups: int | None = None,
) -> DataFrame:
    """Level table `(by..., feature, level, n, value)` from training rows.

    ordinal: position of the level in sorted order; target: positive share smoothed
    towards the group's share by `smooth` rows; onehot: 1.0 for every seen level.
    A null level with n = 0 carries the value for levels not seen in training; null in
    the training rows is a level of its own, null with its count. No task holds all
    levels of a feature: shares are aggregates, positions are sums over ranges.
    """
    by = list(by)
    args = ", ".join(f"'{c}', cast(`{c}` as string)" for c in cols)
    long = train.select(*by, "y", F.expr(f"stack({len(cols)}, {args}) as (feature, level)"))
    levels = long.groupBy(*by, "feature", "level").agg(
        F.count("*").alias("n"), F.sum(F.col("y").cast("bigint")).alias("_pos")
    )
    whole = [*by, "feature"]
    if how == "ordinal":
        ranked = prefix_sum(levels.withColumn("_one", F.lit(1).cast("bigint")), whole, None, [F.col("level")], {"_one": "_rank"})
        levels = ranked.withColumn("value", (F.col("_rank") - 1).cast("double"))
        unseen = levels.select(*whole).distinct().withColumn("value", F.lit(-1.0))
    elif how == "target":
        levels = settle(levels)
        cells = None if groups is None else groups * len(cols)
        prior = settle(levels.groupBy(*whole).agg(ratio(F.sum("_pos"), F.sum("n")).alias("_prior")), cells)
        value = F.try_divide(F.col("_pos") + smooth * F.col("_prior"), F.col("n") + smooth)
        levels = join_small(levels, prior, whole, rows=cells).withColumn("value", value)
        unseen = prior.withColumnRenamed("_prior", "value")
    elif how == "onehot":
        levels = levels.withColumn("value", F.lit(1.0))
        unseen = levels.select(*whole).distinct().withColumn("value", F.lit(0.0))
    else:
        raise ValueError(f"unknown encoding {how!r}")
    return levels.select(*by, "feature", "level", "n", "value").unionByName(
        unseen.select(*by, "feature", F.lit(None).cast("string").alias("level"), F.lit(0).cast("bigint").alias("n"), "value")
    )


def apply_encode(
    df: DataFrame, codes: DataFrame, cols: Sequence[str], by: Sequence[str] = BY, cells: int | None = None
) -> DataFrame:
    """Adds `<col>_code`; levels unseen in training get the reserved value.

    Level tables beyond broadcast size are joined by level, frequent levels apart (see
    `join_levels`), so a level held by a third of the rows does not end in one task.
    """
    by = list(by)
    codes = settle(codes, cells)
    out = df
    for c in cols:
        part = codes.filter(F.col("feature") == c)
        key = lambda v: F.coalesce(F.concat(F.lit("="), v.cast("string")), F.lit("-"))
        seen = part.filter("n > 0").select(*by, key(F.col("level")).alias("_level"), F.col("value").alias("_v"))
        rest = part.filter("n = 0").select(*by, F.col("value").alias("_rest"))
        keyed = out.withColumn("_level", key(F.col(c)))
        keyed = join_levels(keyed, seen, by, "_level", "_v", rows=cells)
        keyed = join_small(keyed, rest, by, "left", rows=cells)
        out = keyed.withColumn(f"{c}_code", F.coalesce("_v", "_rest")).select(*out.columns, f"{c}_code")
    return out


def one_hot(df: DataFrame, codes: DataFrame, col: str, levels: Sequence[str], by: Sequence[str] = BY, cells: int | None = None) -> DataFrame:
    """0/1 columns `<col>_<level>`, and `<col>_other` for levels unseen in training."""
    coded = apply_encode(df, codes, [col], by, cells)
    seen = F.col(f"{col}_code") == 1.0
    listed = F.col(col).isin(*levels)
    flags = {f"{col}_{v}": (seen & F.coalesce(F.col(col) == v, F.lit(False))).cast("int") for v in levels}
    other = (~(seen & F.coalesce(listed, F.lit(False)))).cast("int")
    return coded.withColumns({**flags, f"{col}_other": other}).drop(f"{col}_code")


def tune(scored: DataFrame, thresholds: Sequence[float], metric: str = "f1") -> DataFrame:
    """The label threshold that is best on inner validation scores, per (strategy, seed).

    Every threshold is counted in the same pass; ties go to the smallest threshold.
    """
    grid = scored.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return best_setting(grid.withColumn("y_pred", (F.col("score") > F.col("threshold")).cast("int")), "threshold", metric)


def best_setting(labelled: DataFrame, setting: str, metric: str = "f1") -> DataFrame:
    """The value of a numeric setting whose inner validation labels are best.

    `labelled` holds the predictions of every value, `setting` tells them apart; ties go
    to the smallest value.
    """
    keys = ["experiment", "model", "strategy", "seed", setting]
    values = point_metrics(confusion(labelled, keys), keys).filter(F.col("metric") == metric)
    order = F.struct(F.round("value", 9).alias("v"), (-F.col(setting)).alias("t"))
    return values.groupBy("experiment", "model", "strategy", "seed").agg(
        F.max_by(setting, order).alias(setting), F.max("value").alias("value")
    )
