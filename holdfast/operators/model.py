"""Models that fit every (seed, strategy) at once, and library models fitted one by one."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.functions.expr import ratio
from holdfast.operators.primitives import join_small, settle

KEYS = ["experiment", "model", "strategy", "seed"]
FIT_BYTES = 400  # storage memory a training row takes at most while a library model is fitted (270 measured, and the row held)


def fit_majority(train_set: DataFrame, groups: int | None = None) -> DataFrame:
    """`(seed, strategy, prevalence, label)`; an even split counts as negative."""
    sums = train_set.groupBy("seed", "strategy").agg(
        F.count("*").alias("_n"), F.sum("y").alias("_pos")
    )
    params = sums.select(
        "seed",
        "strategy",
        ratio("_pos", "_n").alias("prevalence"),
        (2 * F.col("_pos") > F.col("_n")).cast("int").alias("label"),
    )
    return settle(params, groups)


def score_majority(
    test: DataFrame, params: DataFrame, experiment: str, groups: int | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    out = join_small(test.select("seed", "id", "y", *keep), params, ["seed"], rows=groups)
    return _as_predictions(out, experiment, "majority", F.col("prevalence"), F.col("label"), keep)


def fit_gnb(
    train_set: DataFrame,
    features: Sequence[str],
    by: Sequence[str] = ("seed", "strategy"),
    groups: int | None = None,
) -> DataFrame:
    """Gaussian naive Bayes for all groups in one aggregate: one wide row per group.

    Columns: `n0, n1`, and per feature `m0_, v0_, m1_, v1_`. Variances are floored at
    1e-9 of the largest feature variance of the group (1e-9 when all are constant).
    """
    classes = train_set.groupBy(*by, "y").agg(*_moments(features))
    return _gnb_rows(classes, features, by, groups)


def fit_gnb_copies(train: DataFrame, features: Sequence[str], groups: int | None = None) -> DataFrame:
    """`fit_gnb` for unbalanced and evenly oversampled training, without making a copy.

    `train` carries `copies` (see `even_copies`). Moments are taken once per (seed, class,
    copies), a handful of rows, and merged with the copies as weights.
    """
    parts = train.groupBy("seed", "y", "copies").agg(*_moments(features))
    plans = F.array(
        F.struct(F.lit("unbalanced").alias("strategy"), F.lit(1).alias("w")),
        F.struct(F.lit("oversampled").alias("strategy"), F.col("copies").alias("w")),
    )
    rows = parts.withColumn("_plan", F.explode(plans)).select("*", "_plan.strategy", "_plan.w").drop("_plan", "copies")
    group = W.partitionBy("seed", "strategy", "y")
    n = {f: F.col("w") * F.col(f"n_{f}") for f in features}
    means = {f"_mean_{f}": F.try_divide(F.sum(n[f] * F.col(f"m_{f}")).over(group), F.sum(n[f]).over(group)) for f in features}
    aggs = [F.sum(F.col("w") * F.col("_rows")).alias("_rows")]
    for f in features:
        off = F.col(f"m_{f}") - F.col(f"_mean_{f}")
        spread = F.sum(n[f] * (F.col(f"v_{f}") + off * off))
        aggs += [
            F.sum(n[f]).alias(f"n_{f}"),
            F.max(f"_mean_{f}").alias(f"m_{f}"),
            F.try_divide(spread, F.sum(n[f])).alias(f"v_{f}"),
        ]
    classes = rows.withColumns(means).groupBy("seed", "strategy", "y").agg(*aggs)
    return _gnb_rows(classes, features, ["seed", "strategy"], groups)


def _moments(features: Sequence[str]) -> list[Column]:
    aggs = [F.count("*").alias("_rows")]
    for f in features:
        c = F.col(f).cast("double")
        aggs += [F.count(c).alias(f"n_{f}"), F.avg(c).alias(f"m_{f}"), F.var_pop(c).alias(f"v_{f}")]
    return aggs


def _gnb_rows(classes: DataFrame, features: Sequence[str], by: Sequence[str], groups: int | None) -> DataFrame:
    """One wide parameter row per group from the moments of its classes."""
    pivot = []
    for c in (0, 1):
        mine = F.col("y") == c
        pivot.append(F.coalesce(F.max(F.when(mine, F.col("_rows"))), F.lit(0)).alias(f"n{c}"))
        for f in features:
            pivot += [F.max(F.when(mine, F.col(f"{s}_{f}"))).alias(f"{s}{c}_{f}") for s in "nmv"]
    wide = classes.groupBy(*by).agg(*pivot)
    tops = [_total_variance(f) for f in features]
    top = F.greatest(*tops) if len(tops) > 1 else tops[0]
    wide = wide.withColumn("_floor", F.when(top > 0, top * 1e-9).otherwise(F.lit(1e-9)))
    cols = [*by, "n0", "n1"]
    for f in features:
        for c in (0, 1):
            v = F.col(f"v{c}_{f}")
            cols += [
                F.col(f"m{c}_{f}"),
                F.when(v.isNotNull(), F.greatest(v, F.col("_floor"))).alias(f"v{c}_{f}"),
            ]
    return settle(wide.select(*cols), groups)


def _total_variance(f: str):
    """Variance of a feature over both classes from the class moments."""
    n0, n1 = (F.coalesce(F.col(f"n{c}_{f}"), F.lit(0)).cast("double") for c in (0, 1))
    m0, m1 = (F.coalesce(F.col(f"m{c}_{f}"), F.lit(0.0)) for c in (0, 1))
    v0, v1 = (F.coalesce(F.col(f"v{c}_{f}"), F.lit(0.0)) for c in (0, 1))
    n = n0 + n1
    between = F.try_divide(n0 * n1 * (m1 - m0) * (m1 - m0), n * n)
    return F.coalesce(F.try_divide(n0 * v0 + n1 * v1, n) + between, F.lit(0.0))


def gnb_params_long(params: DataFrame, features: Sequence[str]) -> DataFrame:
    """The same parameters as `(seed, strategy, transform, feature, stat, value)`."""
    items = [(f, s) for f in features for s in ("m0", "v0", "m1", "v1")]
    args = ", ".join(f"'{f}', '{s}', `{s}_{f}`" for f, s in items)
    return params.select(
        "seed",
        "strategy",
        F.lit("gnb").alias("transform"),
        F.expr(f"stack({len(items)}, {args}) as (feature, stat, value)"),
    )


def _score_terms(params: DataFrame, features: Sequence[str]) -> DataFrame:
    """What of a score depends on the parameters only, so that no row computes it again."""
    prior = F.ln(F.col("n1").cast("double")) - F.ln(F.col("n0").cast("double"))
    terms = {"_prior": F.when((F.col("n0") > 0) & (F.col("n1") > 0), prior)}
    for f in features:
        for c in (0, 1):
            v = F.col(f"v{c}_{f}")
            terms[f"_c{c}_{f}"] = -0.5 * F.ln(2 * math.pi * v)
            terms[f"_w{c}_{f}"] = 2 * v
    return params.withColumns(terms).drop(*[f"v{c}_{f}" for c in (0, 1) for f in features])


def _log_odds(features: Sequence[str]) -> Column:
    total = F.col("_prior")
    for f in features:
        x = F.col(f).cast("double")

        def log_pdf(c: int):
            off = x - F.col(f"m{c}_{f}")
            return F.col(f"_c{c}_{f}") - off * off / F.col(f"_w{c}_{f}")

        total = total + F.coalesce(log_pdf(1) - log_pdf(0), F.lit(0.0))
    return total


def score_gnb(
    test: DataFrame,
    params: DataFrame,
    features: Sequence[str],
    experiment: str,
    groups: int | None = None,
    keep: Sequence[str] = (),
    by: Sequence[str] = ("seed",),
) -> DataFrame:
    """Log-odds score per (strategy, seed, id); label 1 when above 0.

    A missing feature value adds nothing. Where training lacks a class the score is
    null and the label is the class that was seen.
    """
    out = join_small(test, _score_terms(params, features), list(by), rows=groups)
    return label_scores(out, experiment, "gnb", _log_odds(features), keep)


def label_scores(df: DataFrame, experiment: str, model: str, score: Column, keep: Sequence[str]) -> DataFrame:
    """Predictions with label 1 for scores above 0, and the class seen in training (`n1`) without a score.

    The score is a column before the label looks at it: written out in every place, a long
    expression is computed anew in each and makes code too large for the JVM to compile.
    """
    df = df.withColumn("_score", score)
    score = F.col("_score")
    label = F.when(score.isNotNull(), (score > 0).cast("int")).otherwise((F.col("n1") > 0).cast("int"))
    return _as_predictions(df, experiment, model, score, label, keep)


def _as_predictions(df: DataFrame, experiment: str, model: str, score, label, keep: Sequence[str]) -> DataFrame:
    return df.select(
        F.lit(experiment).alias("experiment"),
        F.lit(model).alias("model"),
        "strategy",
        "seed",
        "id",
        "y",
        score.alias("score"),
        label.alias("y_pred"),
        *keep,
    )


def predict(scored: DataFrame, threshold: float) -> DataFrame:
    """Turn scores into labels: 1 above the threshold."""
    return scored.withColumn("y_pred", (F.col("score") > F.lit(threshold)).cast("int"))


def classifier(kind: str, seed: int, **options):
    from pyspark.ml import classification as C

    if kind == "logistic":
        return C.LogisticRegression(**{"maxIter": 50, "standardization": True, **options})
    if kind == "forest":
        return C.RandomForestClassifier(**{"seed": seed, "numTrees": 20, "maxDepth": 5, **options})
    if kind == "boosted":
        return C.GBTClassifier(**{"seed": seed, "maxIter": 10, "maxDepth": 3, **options})
    raise ValueError(f"unknown model {kind!r}")


def fit_ml(kind: str, train: DataFrame, seed: int, features: Sequence[str], weight: str | None = None, **options):
    """One distributed pyspark.ml fit; returns a PipelineModel."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler

    model = classifier(kind, seed, **options)
    if weight:
        model = model.setWeightCol(weight)
    filled = [f"_{f}" for f in features]
    stages = [
        Imputer(inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_x"),
        model.setFeaturesCol("_x").setLabelCol("_y"),
    ]
    return Pipeline(stages=stages).fit(_typed(train, features))


def _typed(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f: F.col(f).cast("double") for f in features}).withColumn("_y", F.col("y").cast("double"))


def score_ml(
    model, test: DataFrame, features: Sequence[str], experiment: str, kind: str, strategy: str, threshold: float = 0.5
) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(_typed(test, features)).withColumn("strategy", F.lit(strategy))
    score = F.get(vector_to_array(F.col("probability")), F.lit(1))
    return _as_predictions(out, experiment, kind, score, (score > threshold).cast("int"), ())


def storage_bytes(spark: SparkSession) -> int:
    """Storage memory of all executors together."""
    sc = spark.sparkContext._jsc.sc()
    own = sc.env().blockManager().blockManagerId().hostPort()
    stores, each = {}, sc.getExecutorMemoryStatus().iterator()
    while each.hasNext():
        store = each.next()
        stores[store._1()] = int(store._2()._1())
    return sum(size for at, size in stores.items() if at != own or len(stores) == 1)  # a driver beside executors holds no rows


def evaluate_ml(
    kinds: Sequence[str],
    train_set: DataFrame,
    test: DataFrame,
    seeds: Sequence[int],
    strategies: Sequence[str],
    features: Sequence[str],
    experiment: str,
    parallel: int = 4,
) -> DataFrame:
    """Fit each (model, strategy, seed) as its own Spark jobs, a few at a time.

    Only the grid is looped over in the driver; rows stay in the cluster. Read the
    inputs from frozen tables, so that each fit prunes to its own partition. A fit passes
    over its rows many times: the balanced rows of a (strategy, seed) are made once and
    held by the executors, in memory and on disk, while all its models are fitted. So many
    cells are fitted at a time, `parallel` at most, as fit in the executors' storage memory:
    beyond it they push each other's rows to disk, and each pass reads them from there.
    """
    cells = [(s, n) for s in strategies for n in seeds]
    rows = train_set.groupBy("seed", "strategy").count().agg(F.max("count")).first()[0] or 1
    parallel = max(1, min(parallel, storage_bytes(train_set.sparkSession) // (FIT_BYTES * rows)))

    def one(cell):
        strategy, seed = cell
        part = train_set.filter((F.col("seed") == seed) & (F.col("strategy") == strategy))
        held = _typed(part, features).select("y", *features).persist()
        try:
            models = [(kind, fit_ml(kind, held, seed, features)) for kind in kinds]
        finally:
            held.unpersist()
        return [score_ml(model, test.filter(F.col("seed") == seed), features, experiment, kind, strategy) for kind, model in models]

    with ThreadPoolExecutor(parallel) as pool:
        scored = [df for part in pool.map(one, cells) for df in part]
    out = scored[0]
    for df in scored[1:]:
        out = out.unionByName(df)
    return out


def compare_models(metrics: DataFrame, base: str) -> DataFrame:
    """Each model against `base` on the same (experiment, strategy, seed, metric)."""
    keys = ["experiment", "strategy", "seed", "metric"]
    reference = metrics.filter(F.col("model") == base).select(*keys, F.col("value").alias("base_value"))
    return (
        metrics.filter(F.col("model") != base)
        .join(reference, keys)
        .select(
            "experiment",
            "model",
            "strategy",
            "seed",
            "metric",
            "value",
            "base_value",
            (F.col("value") - F.col("base_value")).alias("diff"),
        )
    )
