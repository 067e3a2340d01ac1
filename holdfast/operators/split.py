"""Repeated stratified holdout.

The side of a row depends only on md5(seed|salt|id) and on exact integer quotas, so
any engine and any partitioning give the same split. Rows are multiplied by the seeds
with `explode` and meet only tables of seeds x strata rows, so the bulk is never
shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from holdfast.functions.expr import draw_key, ratio
from holdfast.operators.primitives import join_small, kth_key, lookup, settle, within_threshold

SCHEMA = "_schema"  # beside the seeds of a frozen split; readers pass over such names


def each_seed(df: DataFrame, seeds: Sequence[int]) -> DataFrame:
    return df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))


def _stratum(strata: Sequence[str]) -> Column:
    """The value itself for one column; of several, each with its length in front."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in strata]
    return parts[0] if len(parts) == 1 else F.concat(*[F.concat(F.char_length(p).cast("string"), F.lit(":"), p) for p in parts])


def quotas(counts: DataFrame, by: list[str], per_mille: int) -> DataFrame:
    """Test rows per stratum by largest remainder, in integers only.

    `counts` is `(by..., stratum, n)`; decimals keep the products exact for any size.
    """
    whole = W.partitionBy(*by)
    ranked = W.partitionBy(*by).orderBy(F.desc("_rm"), "stratum")
    dec = "decimal(19,0)"
    return (
        counts.withColumn("_all", F.sum("n").over(whole))
        .withColumn("_test", F.expr(f"({per_mille}L * _all + 999L) div 1000L"))
        .withColumn("_fl", F.expr(f"cast(_test as {dec}) * cast(n as {dec}) div cast(_all as {dec})"))
        .withColumn("_rm", F.expr(f"cast(_test as {dec}) * cast(n as {dec}) % cast(_all as {dec})"))
        .withColumn("_rank", F.row_number().over(ranked))
        .withColumn("_extra", F.col("_test") - F.sum("_fl").over(whole))
        .withColumn("k", F.col("_fl") + (F.col("_rank") <= F.col("_extra")).cast("bigint"))
        .select(*by, "stratum", "n", "k")
    )


@dataclass(frozen=True)
class HoldoutPlan:
    """A settled split: quotas per stratum, and per (seed, stratum) the last test key.

    That is seeds x strata rows whatever the cohort's size, and enough to put any row on
    its side without looking at the others again.
    """

    seeds: tuple[int, ...]
    strata: tuple[str, ...]
    entity: str | None
    salt: str
    quota: DataFrame
    thresholds: DataFrame
    groups: int | None
    units: DataFrame | None

    def apply(self, cohort: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """`(seed, id, y, split, keep...)`, without a shuffle unless entities are kept whole."""
        carried = [c for c in dict.fromkeys([*([self.entity] if self.entity else []), *keep]) if c not in ("id", "y")]
        base = cohort.select(*dict.fromkeys(["id", "y", *self.strata, *carried]))
        if self.units is None:
            rows = base.withColumn("stratum", _stratum(self.strata))
        else:
            rows = lookup(base, self.units, self.entity, "_n")
        unit_id = F.col(self.entity or "id")
        sided = join_small(
            each_seed(rows, self.seeds), self.thresholds, ["seed", "stratum"], "left", rows=self.groups
        )
        in_test = within_threshold(draw_key(F.col("seed"), self.salt, unit_id), unit_id)
        return sided.select(
            "seed", "id", "y", F.when(in_test, "test").otherwise("train").alias("split"), *carried
        )

    def train_sizes(self) -> DataFrame | None:
        """Training rows per (seed, y) as the quotas fix them; None when strata are not y."""
        if self.entity or self.strata != ("y",):
            return None
        left = self.quota.select(F.col("stratum").cast("int").alias("y"), (F.col("n") - F.col("k")).alias("n"))
        return each_seed(left.filter("n > 0"), self.seeds)


def plan_holdout(
    cohort: DataFrame,
    seeds: Sequence[int],
    frac: float = 0.2,
    strata: Sequence[str] = ("y",),
    entity: str | None = None,
    salt: str = "split",
) -> HoldoutPlan:
    """Read ids and strata of the cohort and settle the split."""
    units = None
    if entity is None:
        unit = cohort.select(F.col("id").alias("_unit"), _stratum(strata).alias("stratum"))
    else:
        units = (
            cohort.groupBy(entity)
            .agg(F.sum("y").alias("_pos"), F.count("*").alias("_n"))
            .select(entity, (2 * F.col("_pos") > F.col("_n")).cast("int").cast("string").alias("stratum"), "_n")
        )
        units = settle(units)
        if not units.filter(F.col(entity).isNull()).isEmpty():
            raise ValueError(f"rows without {entity} cannot be kept on one side")
        unit = units.select(F.col(entity).alias("_unit"), "stratum")
    groups = 2 * len(seeds) if entity or tuple(strata) == ("y",) else None
    counts = unit.groupBy("stratum").agg(F.count("*").alias("n"))
    quota = settle(quotas(counts, [], round(frac * 1000)), groups)
    key = draw_key(F.col("seed"), salt, F.col("_unit"))
    thresholds = kth_key(each_seed(unit, seeds), ["seed", "stratum"], each_seed(quota, seeds), key, "_unit", groups)
    return HoldoutPlan(tuple(seeds), tuple(strata), entity, salt, quota, thresholds, groups, units)


def holdout(
    cohort: DataFrame,
    seeds: Sequence[int],
    frac: float = 0.2,
    strata: Sequence[str] = ("y",),
    entity: str | None = None,
    salt: str = "split",
    keep: Sequence[str] = (),
) -> DataFrame:
    """For each seed put every row on the train or test side, keeping class shares.

    Returns `(seed, id, y, split, keep...)`. With `entity` all rows of one entity land
    on one side and the stratum is the entity's majority class.
    """
    return plan_holdout(cohort, seeds, frac, strata, entity, salt).apply(cohort, keep)


def inner_holdout(
    splits: DataFrame, frac: float = 0.2, salt: str = "inner", groups: int | None = None
) -> DataFrame:
    """Split the training rows once more; `split` becomes `fit` or `valid`."""
    train = splits.filter(F.col("split") == "train").withColumn("stratum", F.col("y").cast("string"))
    key = draw_key(F.col("seed"), salt, F.col("id"))
    counts = train.groupBy("seed", "stratum").agg(F.count("*").alias("n"))
    quota = settle(quotas(counts, ["seed"], round(frac * 1000)), groups)
    thr = kth_key(train.select("seed", "stratum", "id"), ["seed", "stratum"], quota, key, groups=groups)
    sided = join_small(train, thr, ["seed", "stratum"], "left", rows=groups)
    in_valid = within_threshold(key, F.col("id"))
    return sided.withColumn("split", F.when(in_valid, "valid").otherwise("fit")).drop(
        "stratum", "thr_key", "thr_tie"
    )


def split_report(splits: DataFrame) -> DataFrame:
    """Per seed the class share of train, test and cohort, and the largest deviation."""
    test, pos = F.col("split") == "test", F.col("y") == 1
    out = splits.groupBy("seed").agg(
        F.count_if(~test).alias("n_train"),
        F.count_if(test).alias("n_test"),
        F.count_if(~test & pos).alias("pos_train"),
        F.count_if(test & pos).alias("pos_test"),
    )
    out = (
        out.withColumn("share_train", ratio("pos_train", "n_train"))
        .withColumn("share_test", ratio("pos_test", "n_test"))
        .withColumn(
            "share_all",
            ratio(F.col("pos_train") + F.col("pos_test"), F.col("n_train") + F.col("n_test")),
        )
    )
    dev = F.greatest(
        F.abs(F.col("share_train") - F.col("share_all")),
        F.abs(F.col("share_test") - F.col("share_all")),
    )
    return out.withColumn("max_dev", dev)


def freeze(splits: DataFrame, path: str) -> DataFrame:
    """Write the split once, by seed, with its schema, and hand back a reader of what was written."""
    splits.write.partitionBy("seed").parquet(path)
    note = splits.sparkSession.createDataFrame([(splits.schema.json(),)], "value string")
    note.coalesce(1).write.text(f"{path}/{SCHEMA}")
    return thaw(splits.sparkSession, path)


def thaw(spark, path: str) -> DataFrame:
    """A frozen split in the types it was written with, the partition column `seed` included."""
    schema = StructType.fromJson(json.loads(spark.read.text(f"{path}/{SCHEMA}").first()[0]))
    df = spark.read.schema(schema).parquet(path)
    return df.select("seed", *[c for c in df.columns if c != "seed"])
