"""Class balancing of training rows. Nothing here ever sees a test row.

Input is `(seed, id, y, ...)`; output adds `strategy`, `copy_no` (0 for the original)
and `synthetic`, or `weight` for class weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.functions.expr import draw_key, hash60, ratio, unit
from holdfast.operators.neighbours import marked, nearest_lists, node_key, nodes_of
from holdfast.operators.primitives import (
    SALTS,
    hex_digits,
    join_small,
    kth_key,
    prefix_sum,
    settle,
    within_threshold,
)

HOT_COPIES = 100_000  # rows of one content from which on they are dealt to several tasks

NAMES = {
    "none": "unbalanced",
    "even": "oversampled",
    "replace": "replacement",
    "weight": "weighted",
    "synthetic": "synthetic",
    "interpolated": "interpolated",
}


def balance(
    train: DataFrame,
    how: str,
    groups: int | None = None,
    features: Sequence[str] = (),
    k: int = 5,
) -> DataFrame:
    if how == "none":
        out = _mark(train, how)
    elif how == "even":
        out = _mark(_repeat(even_copies(train, groups)), how)
    elif how == "replace":
        out = _mark(with_replacement(train, groups), how)
    elif how == "weight":
        out = _mark(class_weights(train, groups), how)
    elif how == "synthetic":
        out = _mark(synthetic_rows(train, features, k, groups), how)
    elif how == "interpolated":
        out = _mark(interpolated_rows(train, features, groups), how)
    else:
        raise ValueError(f"unknown balancing {how!r}")
    return out


def _mark(df: DataFrame, how: str) -> DataFrame:
    df = df.withColumn("strategy", F.lit(NAMES[how]))
    if "copy_no" not in df.columns:
        df = df.withColumn("copy_no", F.lit(0))
    if "synthetic" not in df.columns:
        df = df.withColumn("synthetic", F.lit(False))
    return df


def class_sizes(train: DataFrame, groups: int | None = None) -> DataFrame:
    """`(seed, y, n, n_max)`: seeds x classes rows, settled."""
    return settle(_with_largest(train.groupBy("seed", "y").agg(F.count("*").alias("n"))), groups)


def _with_largest(sizes: DataFrame) -> DataFrame:
    return sizes.withColumn("n_max", F.max("n").over(W.partitionBy("seed")))


def even_copies(train: DataFrame, groups: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Adds `copies`: n_max div n, plus one for the first n_max % n rows of a class.

    `sizes` `(seed, y, n)` saves counting where the split already fixes them.
    """
    sizes = class_sizes(train, groups) if sizes is None else _with_largest(sizes)
    sizes = sizes.withColumn("k", F.col("n_max") % F.col("n"))
    key = draw_key(F.col("seed"), "os", F.col("id"))
    thr = kth_key(train.select("seed", "y", "id"), ["seed", "y"], sizes, key, groups=groups)
    params = join_small(
        sizes.select("seed", "y", F.expr("n_max div n").alias("_base")),
        thr,
        ["seed", "y"],
        "left",
        rows=groups,
    )
    first = within_threshold(key, F.col("id"))
    return (
        join_small(train, params, ["seed", "y"], rows=groups)
        .withColumn("copies", (F.col("_base") + first.cast("int")).cast("int"))
        .drop("_base", "thr_key", "thr_tie")
    )


def _repeat(df: DataFrame) -> DataFrame:
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop(
        "copies"
    )


def unbalanced_and_even(
    train: DataFrame, groups: int | None = None, sizes: DataFrame | None = None
) -> DataFrame:
    """Both compared strategies out of one pass over the training rows."""
    plans = F.array(
        F.struct(F.lit(NAMES["none"]).alias("strategy"), F.lit(1).alias("copies")),
        F.struct(F.lit(NAMES["even"]).alias("strategy"), F.col("copies").alias("copies")),
    )
    both = even_copies(train, groups, sizes).withColumn("_plan", F.explode(plans))
    return _repeat(
        both.withColumn("strategy", F.col("_plan.strategy"))
        .withColumn("copies", F.col("_plan.copies"))
        .drop("_plan")
    ).withColumn("synthetic", F.lit(False))


def _indexed(train: DataFrame, classes: DataFrame, groups: int | None) -> DataFrame:
    """Rows of the given classes with a dense index from 0 in digest order, `_ix`."""
    keyed = train.withColumn("key", draw_key(F.col("seed"), "ix", F.col("id")))
    rows = join_small(keyed, classes.select("seed", "y", hex_digits(F.col("n")).alias("_d")), ["seed", "y"], rows=groups)
    return (
        prefix_sum(
            rows.withColumn("_b", F.col("key").substr(F.lit(1), F.col("_d"))).withColumn(
                "_one", F.lit(1).cast("bigint")
            ),
            ["seed", "y"],
            "_b",
            [F.col("key"), F.col("id")],
            {"_one": "_rank"},
        )
        .withColumn("_ix", F.col("_rank") - 1)
        .drop("key", "_d", "_b", "_one", "_rank")
    )


def with_replacement(train: DataFrame, groups: int | None = None) -> DataFrame:
    """Originals plus n_max - n hashed draws per class.

    Draw numbers come in blocks of about sqrt(deficit), spread over tasks before they
    are written out, and meet the rows on a dense index.
    """
    sizes = class_sizes(train, groups).withColumn("deficit", F.col("n_max") - F.col("n"))
    short = sizes.filter(F.col("deficit") > 0)
    indexed = _indexed(train, short, groups)
    draws = (
        short.withColumn("_size", F.ceil(F.sqrt(F.col("deficit").cast("double"))))
        .withColumn("_block", F.explode(F.expr("sequence(0L, (deficit - 1) div _size)")))
        .repartition("seed", "y", "_block")
        .withColumn(
            "_draw",
            F.explode(F.expr("sequence(_block * _size + 1, least(deficit, (_block + 1) * _size))")),
        )
        .select(
            "seed",
            "y",
            "_draw",
            F.pmod(hash60(draw_key(F.col("seed"), "draw", F.col("y"), F.col("_draw"))), F.col("n")).alias("_ix"),
        )
    )
    nth = F.row_number().over(W.partitionBy("seed", "y", "_ix").orderBy("_draw"))
    copies = indexed.join(draws, ["seed", "y", "_ix"]).withColumn("copy_no", nth)
    return train.withColumn("copy_no", F.lit(0)).unionByName(copies.select(*train.columns, "copy_no"))


def class_weights(train: DataFrame, groups: int | None = None) -> DataFrame:
    """weight = n_max / n of the row's class; no row growth."""
    sizes = class_sizes(train, groups).select("seed", "y", ratio("n_max", "n").alias("weight"))
    return join_small(train, sizes, ["seed", "y"], rows=groups)


def synthetic_rows(train: DataFrame, features: Sequence[str], k: int = 5, groups: int | None = None) -> DataFrame:
    """Originals plus minority rows interpolated towards one of their k nearest rows of the class.

    Neighbours are exact, by squared distance over the features and then id, within the
    training rows of the same seed and class; null, NaN and infinite features lie at 0 there.
    The copies that even oversampling would make each move towards a neighbour drawn by
    digest, by a digest's share of the way. A feature that is null in either row is null; the
    only row of a class stays where it is. Ids are unique within a seed.
    """
    keys = ["seed", "y"]
    sizes = class_sizes(train, groups)
    short = sizes.filter(F.col("n") < F.col("n_max")).select(*keys)
    rows = join_small(train, short, keys, rows=groups)
    # seeds share most of their rows, so that a content is searched once for all of them
    nodes = nodes_of(rows, ["y"], features, k + 1, within="seed")
    base = join_small(even_copies(train, groups), short, keys, rows=groups).filter("copies > 1")
    base = base.withColumn("node", node_key(features))
    # lists go where their rows go, once; those of contents with many rows go to many tasks
    hot = settle(base.groupBy("y", "node").agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT_COPIES).drop("_n"))
    lists = nearest_lists(nodes, ["y"], k + 1, groups, hot=hot).withColumnRenamed("near", "_near")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("seed", "id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    base = marked(base, hot, ["y", "node"]).withColumn("salt", salt).drop("_hot").join(lists, ["y", "node", "salt"]).drop("salt")
    first = F.slice(F.filter("_near", lambda s: F.array_contains(s["of"], F.col("seed"))), 1, k + 1)
    others = F.slice(F.filter(first, lambda s: s["id"] != F.col("id")), 1, k)
    made = base.withColumn("_near", others).withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies") - 1)))
    draw = hash60(draw_key(F.col("seed"), "syn", F.col("id"), F.col("copy_no")))
    step = unit(draw_key(F.col("seed"), "step", F.col("id"), F.col("copy_no")))
    pick = F.get("_near", F.pmod(draw, F.greatest(F.size("_near"), F.lit(1))).cast("int"))
    made = made.withColumn("_other", pick["other"]).withColumn("_step", step).drop("_near", "node")
    partner = nodes.select(F.col("nr").alias("_other"), F.col("x").alias("_to"))
    x = {f: F.col(f).cast("double") for f in features}
    moved = {f: F.when(F.col("_other").isNull(), c).otherwise(c + (F.get("_to", F.lit(i)) - c) * F.col("_step")) for i, (f, c) in enumerate(x.items())}
    original = train.withColumn("copy_no", F.lit(0)).withColumn("synthetic", F.lit(False)).withColumns(x)
    made = made.join(partner, "_other", "left").withColumns(moved).withColumn("synthetic", F.lit(True))
    return original.unionByName(made.select(*original.columns))


def interpolated_rows(train: DataFrame, features: Sequence[str], groups: int | None = None) -> DataFrame:
    """Originals plus minority rows interpolated between random pairs of their class.

    The copies that even oversampling would make each move towards a partner, drawn by
    digest from the training rows of the same seed and class, by a digest's share of the
    way. A feature that is null in either row is null. The partner is found on a dense
    index, so the rule is the same for a class of ten rows and one of a billion.
    """
    sizes = class_sizes(train, groups)
    short = sizes.filter(F.col("n") < F.col("n_max"))
    base = join_small(even_copies(train, groups), short.select("seed", "y", "n"), ["seed", "y"], rows=groups)
    made = base.filter("copies > 1").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies") - 1)))
    made = made.withColumn(
        "_ix", F.pmod(hash60(draw_key(F.col("seed"), "syn", F.col("id"), F.col("copy_no"))), F.col("n"))
    ).withColumn("_step", unit(draw_key(F.col("seed"), "step", F.col("id"), F.col("copy_no"))))
    partner = _indexed(train, short, groups).select("seed", "y", "_ix", *[F.col(f).alias(f"_to_{f}") for f in features])
    x = {f: F.col(f).cast("double") for f in features}
    moved = {f: c + (F.col(f"_to_{f}").cast("double") - c) * F.col("_step") for f, c in x.items()}
    original = train.withColumn("copy_no", F.lit(0)).withColumn("synthetic", F.lit(False)).withColumns(x)
    made = made.join(partner, ["seed", "y", "_ix"]).withColumns(moved).withColumn("synthetic", F.lit(True))
    return original.unionByName(made.select(*original.columns))


def balance_report(splits: DataFrame, train_set: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """Class counts per (seed, strategy, side, class) before and after balancing."""
    before = (
        splits.groupBy("seed", F.col("split").alias("side"), "y")
        .agg(F.count("*").alias("n_before"))
        .withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in strategies])))
    )
    after = train_set.groupBy("seed", "strategy", "y").agg(F.count("*").alias("_after"))
    is_train = F.col("side") == "train"
    return before.join(after, ["seed", "strategy", "y"], "left").select(
        "seed",
        "strategy",
        "side",
        "y",
        "n_before",
        F.when(is_train, F.coalesce("_after", F.lit(0))).otherwise(F.col("n_before")).alias("n_after"),
    )
