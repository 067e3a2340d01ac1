"""Mixing strata to target weights by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdfast.functions.expr import draw_key, unit
from holdfast.llm.common import WORD, keep
from holdfast.operators.primitives import join_small

# Ranges of the sampling key within a stratum; prefix sums run over ranges, then inside one.
RANGES = 4096


def stratum_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(stratum, source_size, target) from (stratum, source_size), one row per stratum.

    Strata in code point order, null last, have the `weights` in turn. `share` of all sizes
    is dealt out by weight; a target stops at `most` times its stratum and the excess goes to
    the others by weight. The point where that ends is found by one prefix sum over the
    strata in order of cap by weight, instead of round by round.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy(F.col("stratum").isNull(), F.col("stratum").cast("binary"))
    ranked = sizes.withColumn("_w", F.element_at(turn, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    every = Window.partitionBy()
    up = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("stratum").isNull(), F.col("stratum").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    open_ = (
        ranked.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_all", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("_caps", F.coalesce(F.sum("_cap").over(up), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(up), F.lit(0.0)))
        .withColumn("_level", (F.col("_all") - F.col("_caps")) / F.col("_left"))
        .withColumn("_capped", F.col("_cap") <= F.col("_w") * F.col("_level"))
    )
    level = F.min(F.when(~F.col("_capped"), F.struct("_caps", "_level"))).over(every)["_level"]
    return open_.withColumn("_final", level).select(
        "stratum", "source_size",
        F.when(F.col("_capped") | F.col("_final").isNull(), F.col("_cap")).otherwise(F.col("_w") * F.col("_final")).alias("target"),
    )


def _keyed(cohort: DataFrame, quality: DataFrame | None, seed: int, id: str, stratum: str, more: list[Column]) -> DataFrame:
    """(id, stratum, _key, _range, _s, more...): the sampling key of each row and its range of keys."""
    rows = cohort.select(F.col(id).alias("id"), F.col(stratum).alias("stratum"), *more)
    if quality is not None:
        best = quality.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("_id")).agg(F.max("weight").alias("_q"))
        rows = rows.join(best, F.col("id") == F.col("_id"), "left").drop("_id")
    else:
        rows = rows.withColumn("_q", F.lit(None).cast("double"))
    u = unit(draw_key(F.lit(seed), "mix", F.coalesce(F.col("id").cast("string"), F.lit("null")))) + F.lit(2.0**-54)
    return (
        rows.withColumn("_key", -F.log(u) / F.coalesce(F.col("_q"), F.lit(1.0)))
        .withColumn("_range", F.floor((1 - F.exp(-F.col("_key"))) * RANGES).cast("int"))
        .withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col("stratum")), F.lit("")))
        .drop("_q")
    )


def _placed(rows: DataFrame, weights: tuple[float, ...], share: float, most: float, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with the words before each in its stratum, `_until`, and the targets by stratum `_s`:
    whole epochs, then words still needed."""
    if min(weights) <= 0 or most < share:
        raise ValueError("weights must be above 0 and most at least share")
    sums = rows.groupBy("_s", "_range").agg(F.sum("size").alias("_words"))
    sizes = sums.groupBy("_s").agg(F.sum("_words").alias("source_size")).withColumn(
        "stratum", F.when(F.col("_s") == "", None).otherwise(F.expr("substring(_s, 2)"))
    )
    targets = stratum_targets(sizes.select("stratum", "source_size"), weights, share, most).select(
        F.coalesce(F.concat(F.lit("="), F.col("stratum")), F.lit("")).alias("_s"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("_epochs"),
    ).withColumn("_need", F.floor(F.col("target") + 0.5).cast("long") - F.col("_epochs") * F.col("source_size"))
    up = Window.partitionBy("_s").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = sums.withColumn("_before", F.sum("_words").over(up) - F.col("_words")).join(targets, "_s").drop("_words")
    inside = Window.partitionBy("_s", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(ranges, ["_s", "_range"]).withColumn("_until", F.col("_before") + F.sum("size").over(inside) - F.col("size")), targets


def _words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")


def mix_strata(
    cohort: DataFrame,
    quality: DataFrame | None = None,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
    id: str = "id",
    text: str = "text",
    stratum: str = "stratum",
) -> DataFrame:
    """(id, size, source_size, target, taken), one row per cohort row.

    A row's size is the number of its words. Each stratum gets a target (`stratum_targets`)
    and is taken whole as often as the target holds it; the rest is drawn by
    Efraimidis-Spirakis keys, -ln(u) / weight with u from a digest of seed and id, lowest
    keys first, until the words reach the target. The row at the edge is taken in part, so a
    stratum's words equal its rounded target. `quality` holds (id, weight) with weights over
    0; rows without one weigh 1.

    Null text: size 0, nothing taken. Null strata are one stratum; null ids are drawn by
    their own digest and weigh 1. Equal keys are ordered by id and size; rows equal in both
    are interchangeable. No row is taken more than `most` times. Reruns agree. Other columns
    may have any name.

    A stratum is never sorted in one task: words are summed by (stratum, key range), range
    sums are added up, and rows are ordered inside their range only.
    """
    rows = _keyed(cohort, quality, seed, id, stratum, [_words(text)])
    out, _ = _placed(rows, weights, share, most, ["_key", "id", "size"])
    taken = F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("_need") - F.col("_until")))
    return out.select("id", "size", "source_size", "target", taken.alias("taken"))


def mixed_rows(
    cohort: DataFrame,
    quality: DataFrame | None = None,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
    id: str = "id",
    text: str = "text",
    stratum: str = "stratum",
) -> DataFrame:
    """The cohort's rows, all columns, each as often as the mix of `mix_strata` takes it.

    Every row is taken whole: once for each epoch of its stratum, and once more if it comes
    before the edge in the order of keys. The row at the edge is taken whole or not at all,
    whichever brings the stratum's words nearer to the target (whole on a tie). The same
    rule holds for rows without words. Rows equal in id and text are taken or left together
    at the edge.

    The edge is found on ids, strata and sizes alone. Rows then meet their weight by id, and
    the edges, one row a stratum, map-side; texts move at most once.
    """
    tie = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_tie")
    place = F.struct("_key", "id", "_tie")
    narrow, targets = _placed(_keyed(cohort, quality, seed, id, stratum, [_words(text), tie]), weights, share, most, ["_key", "id", "_tie"])
    at_edge = (F.col("_until") < F.col("_need")) & (F.col("_need") <= F.col("_until") + F.col("size"))
    whole = 2 * (F.col("_need") - F.col("_until")) >= F.col("size")
    edges = narrow.where(at_edge).groupBy(F.col("_s").alias("_at")).agg(F.max(F.struct(place.alias("place"), whole.alias("whole"))).alias("_edge"))
    judged = keep(targets.join(edges, F.col("_s") == F.col("_at"), "left").select("_s", "_epochs", "_edge"), "edges")
    row = F.struct(*[F.col(f"`{c}`") for c in cohort.columns]).alias("_row")
    rows = join_small(_keyed(cohort, quality, seed, id, stratum, [tie, row]), judged, ["_s"])
    more = F.col("_edge").isNotNull() & ((place < F.col("_edge.place")) | ((place == F.col("_edge.place")) & F.col("_edge.whole")))
    copies = (F.col("_epochs") + F.coalesce(more, F.lit(False)).cast("int")).cast("int")
    return rows.withColumn("_copies", copies).where("_copies > 0").withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
