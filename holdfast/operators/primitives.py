"""Building blocks that keep huge groups off single tasks.

A stratified split has few groups (seed x class) with many rows each, which a plain
window would sort in one task per group. The forms here look at a group through a
histogram of about sqrt(n) entries and sort only the one bucket that matters.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.session import new_path

BROADCAST_ROWS = 100_000
SALTS = 64
HOT_LEVELS = 1_000
HOT_ROWS = 1_000_000
#: Rows of one window at most; beyond it a group is dealt into ranges.
RANGE_ROWS = 1_000_000


def settle(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Compute a parameter table once, so that later plans hold its rows, not its lineage.

    With a proven bound of `rows` the table becomes a local relation, and a table beyond
    its bound is an error; without one it is written to the shared folder and read back,
    whatever its size.
    """
    spark = df.sparkSession
    if rows is not None and rows <= BROADCAST_ROWS:
        held = df.limit(rows + 1).toArrow()
        if held.num_rows > rows:
            raise ValueError(f"more than the {rows} parameter rows that were promised")
        return spark.createDataFrame(held, schema=df.schema)
    path = new_path(spark, "params")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_small(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int | None = None
) -> DataFrame:
    """Join a parameter-sized table without ever hashing the big side on few keys.

    `rows` is a bound on `small` the caller can prove (seeds x classes, say). Without
    one the small side is counted, up to the limit. Beyond the limit both sides are
    salted, so that a key holding a third of all rows is spread over tasks.
    """
    if rows is None:
        rows = small.limit(BROADCAST_ROWS + 1).count()
    if rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = big.withColumn(
        "_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(SALTS)).cast("int")
    )
    return spread.join(salted, [*on, "_salt"], how).drop("_salt")


def lookup(
    big: DataFrame, dim: DataFrame, on: str, weight: str, hot: int = HOT_ROWS
) -> DataFrame:
    """Left join `dim` (unique on `on`) where some keys may be very frequent in `big`.

    `weight` in `dim` is the number of rows the key has in `big`. Keys with `hot` rows
    or more are at most rows(big) / hot, so that part is broadcast; rows already
    answered are spread over a salt, the rest take the ordinary shuffle join.
    """
    values = [c for c in dim.columns if c not in (on, weight)]
    heavy = dim.filter(F.col(weight) >= hot).select(
        on, F.lit(True).alias("_heavy"), *[F.col(v).alias(f"_h_{v}") for v in values]
    )
    light = dim.filter(F.col(weight) < hot).select(
        on, F.lit(0).cast("bigint").alias("_salt"), *[F.col(v).alias(f"_l_{v}") for v in values]
    )
    salt = F.when(F.col("_heavy"), F.lit(1) + F.pmod(F.xxhash64(*big.columns), F.lit(4096)))
    marked = big.join(F.broadcast(heavy), on, "left").withColumn(
        "_salt", F.coalesce(salt, F.lit(0)).cast("bigint")
    )
    out = marked.join(light, [on, "_salt"], "left")
    return out.select(
        *big.columns, *[F.coalesce(f"_h_{v}", f"_l_{v}").alias(v) for v in values]
    )


def join_levels(
    big: DataFrame, levels: DataFrame, by: list[str], level: str, value: str, rows: int | None = None
) -> DataFrame:
    """Left join of a level table, unique on (by, level), of any size; adds `value`.

    Up to the broadcast limit the table is broadcast. Beyond it a frequent-items sketch
    over `big` names at most `HOT_LEVELS` levels; their part of the table is looked up
    map-side and their rows, known to the table or not, are spread over a salt, while all
    other levels take one ordinary join. Nothing is copied; the sketch affects where rows
    go, never the result. `level` must not be null in `big`.
    """
    if rows is None:
        rows = levels.limit(BROADCAST_ROWS + 1).count()
    if rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(levels), [*by, level], "left").select(*big.columns, value)
    tracked = 16 * HOT_LEVELS
    top = big.agg(F.expr(f"approx_top_k(`{level}`, {HOT_LEVELS}, {tracked})").alias("top")).first()["top"] or []
    often = F.col(level).isin([t["item"] for t in top])
    near = levels.filter(often).withColumnRenamed(value, "_near")
    far = levels.filter(~often).withColumnRenamed(value, "_far").withColumn("_salt", F.lit(0).cast("bigint"))
    spread = F.when(often, F.lit(1) + F.pmod(F.xxhash64(*big.columns), F.lit(4096))).otherwise(F.lit(0))
    out = join_small(big.withColumn("_salt", spread.cast("bigint")), near, [*by, level], "left")
    out = out.join(far, [*by, level, "_salt"], "left")
    return out.select(*big.columns, F.coalesce("_near", "_far").alias(value))


def hex_digits(n: Column) -> Column:
    """How many leading hex digits split n uniform digests into about sqrt(n) buckets."""
    return F.least(
        F.lit(6),
        F.greatest(F.lit(1), F.ceil(F.log(n.cast("double")) / F.lit(2 * math.log(16)))),
    ).cast("int")


def _hex_at(share: Column) -> Column:
    """The 12-digit hex prefix at a share of the digest space; beyond all of it at 1."""
    digits = F.lpad(F.lower(F.hex(F.floor(share * F.lit(float(16**12))).cast("bigint"))), 12, "0")
    return F.when(share <= 0, "").when(share >= 1, "g").otherwise(digits)


def _size(df: DataFrame, groups: int | None) -> int:
    return df.count() if groups is None or groups > BROADCAST_ROWS else len(df.collect())


def kth_key(
    rows: DataFrame,
    group: list[str],
    quota: DataFrame,
    key: Column,
    tie: str = "id",
    groups: int | None = None,
) -> DataFrame:
    """Per group the k-th smallest (key, tie): `(group..., thr_key, thr_tie)`, settled.

    `key` is a hex digest computed from columns of `rows`; `quota` holds group, its row
    count `n` and the wanted `k`. Groups with k = 0 give no row.

    Digests are uniform, so the k-th of n lies near the share k/n of the digest space.
    One pass counts the rows below a bracket of six standard deviations (map-side) and
    keeps the about 12 sqrt(n) rows inside it. Should the rank fall outside for any
    group, which repeated keys can cause, a digest-prefix histogram finds it for all.
    """
    n, k = F.col("n").cast("double"), F.least("k", "n").cast("double")
    margin = (6 * F.sqrt(k * (1 - k / n)) + 24) / n
    want = settle(
        quota.filter(F.col("k") > 0).select(
            *group,
            F.least("k", "n").cast("bigint").alias("_k"),
            _hex_at(k / n - margin).alias("_lo"),
            _hex_at(k / n + margin).alias("_hi"),
            hex_digits(F.col("n")).alias("_digits"),
        ),
        groups,
    )
    thr = settle(_bracketed(rows, group, want, key, tie, groups), groups)
    if _size(thr, groups) < _size(want, groups):
        thr = settle(_by_histogram(rows, group, want, key, tie, groups), groups)
    return thr


def _bracketed(rows, group, want, key, tie, groups) -> DataFrame:
    inside = F.col("_key") >= F.col("_lo")
    kept = (
        join_small(rows, want.drop("_digits"), group, rows=groups)
        .withColumn("_key", key)
        .filter(F.col("_key") <= F.col("_hi"))
        .groupBy(
            *group,
            "_k",
            F.when(inside, F.col("_key")).otherwise("").alias("_key"),
            F.when(inside, F.col(tie)).alias("_tie"),
        )
        .agg(F.count("*").alias("_cnt"))
    )
    running = F.sum("_cnt").over(
        W.partitionBy(*group).orderBy("_key", "_tie").rowsBetween(W.unboundedPreceding, 0)
    )
    return (
        kept.withColumn("_cum", running)
        .filter((F.col("_cum") - F.col("_cnt") < F.col("_k")) & (F.col("_k") <= F.col("_cum")))
        .filter(F.col("_key") != "")
        .select(*group, F.col("_key").alias("thr_key"), F.col("_tie").alias("thr_tie"))
    )


def _by_histogram(rows, group, want, key, tie, groups) -> DataFrame:
    """Two passes, exact for any keys: counts by prefix, then the one bucket that matters.

    Rows of one (key, tie) are one counter there; where repeated keys make the bucket
    large, its counters are summed over ranges.
    """
    prefix = F.col("_key").substr(F.lit(1), F.col("_digits"))
    hist = (
        join_small(rows, want.select(*group, "_k", "_digits"), group, rows=groups)
        .withColumn("_key", key)
        .groupBy(*group, "_k", "_digits", prefix.alias("_bucket"))
        .agg(F.count("*").alias("_cnt"))
    )
    running = F.sum("_cnt").over(
        W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    )
    edge = (
        hist.withColumn("_cum", running)
        .filter((F.col("_cum") - F.col("_cnt") < F.col("_k")) & (F.col("_k") <= F.col("_cum")))
        .select(
            *group,
            "_digits",
            "_bucket",
            (F.col("_k") - F.col("_cum") + F.col("_cnt")).alias("_need"),
            F.col("_cnt").alias("_size"),
        )
    )
    edge = settle(edge, groups)
    same = (
        join_small(rows, edge.drop("_size"), group, rows=groups)
        .withColumn("_key", key)
        .filter(prefix == F.col("_bucket"))
        .groupBy(*group, "_need", "_key", F.col(tie).alias("_tie"))
        .agg(F.count("*").alias("_cnt"))
    )
    placed = _running(same, group, [F.col("_key"), F.col("_tie")], "_cnt", "_cum", edge, "_size")
    return placed.filter((F.col("_cum") - F.col("_cnt") < F.col("_need")) & (F.col("_need") <= F.col("_cum"))).select(
        *group, F.col("_key").alias("thr_key"), F.col("_tie").alias("thr_tie")
    )


def _running(
    df: DataFrame, group: list[str], order: list[Column], val: str, name: str, sizes: DataFrame, size: str
) -> DataFrame:
    """Running sums per group: one window while the largest group, by column `size` of the
    settled table `sizes`, is within `RANGE_ROWS`, else windows over ranges. Same result."""
    largest = sizes.agg(F.max(size)).first()[0]
    if largest is None or largest <= RANGE_ROWS:
        over = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(val).over(over))
    return prefix_sum(df, group, None, order, {val: name})


def within_threshold(key: Column, tie: Column) -> Column:
    """True for rows up to the threshold row; false where the group has none.

    A key given as an expression is computed only for groups with a threshold, and once
    a row: key and tie are compared as one value where none is null.
    """
    thr_key, thr_tie = F.col("thr_key"), F.col("thr_tie")
    known = key.isNotNull() & tie.isNotNull() & thr_tie.isNotNull()
    together = F.struct(key.alias("k"), tie.alias("t")) <= F.struct(thr_key.alias("k"), thr_tie.alias("t"))
    apart = (key < thr_key) | ((key == thr_key) & (tie <= thr_tie))
    return F.when(thr_key.isNull(), F.lit(False)).when(known, together).otherwise(apart)


def take_k(
    df: DataFrame,
    group: list[str],
    quota: DataFrame,
    key: str = "key",
    tie: str = "id",
    groups: int | None = None,
) -> DataFrame:
    """Exactly k rows per group, the smallest by (key, tie), in a map-side last pass."""
    thr = kth_key(df, group, quota, F.col(key), tie, groups)
    return (
        join_small(df, thr, group, "inner", rows=groups)
        .filter(within_threshold(F.col(key), F.col(tie)))
        .drop("thr_key", "thr_tie")
    )


def range_buckets(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds `name`, a number that rises with (group, order), by ranges of even size.

    The rows are stored and counted first: there are as many ranges as keep each near
    `RANGE_ROWS`, and no fewer than shuffle partitions. Spark samples the ranges; the
    numbers are written with the rows, so that every later plan sees the same ones.
    """
    spark = df.sparkSession
    rows = settle(df)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    ranged = rows.repartitionByRange(ranges, *group, *order).withColumn(name, F.spark_partition_id())
    path = new_path(spark, "ranges")
    ranged.write.parquet(path)
    return spark.read.schema(ranged.schema).parquet(path)


def prefix_sum(
    df: DataFrame, group: list[str], bucket: str | None, order: list[Column], vals: dict[str, str]
) -> DataFrame:
    """Running sums over a whole group, windowed only inside (group, bucket).

    `bucket` must rise with `order`; without one, ranges of even size are made, so that
    no window grows with the data. `vals` maps an input column to its output name.
    The bucket totals come back by an equi-join on the keys the window needs anyway.
    """
    if bucket is None:
        return prefix_sum(range_buckets(df, group, order, "_range"), group, "_range", order, vals).drop("_range")
    keys = [*group, bucket]
    totals = df.groupBy(*keys).agg(*[F.sum(v).alias(f"_t_{v}") for v in vals])
    earlier = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in vals],
    )
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = df.join(offsets, keys)
    for v, name in vals.items():
        out = out.withColumn(name, F.col(f"_o_{v}") + F.sum(v).over(inside))
    return out.drop(*[f"_o_{v}" for v in vals])


def exact_percentiles(
    df: DataFrame, by: list[str], features: Sequence[str], ps: Sequence[float], groups: int | None = None
) -> DataFrame:
    """Exact linear-interpolated percentiles: `(by..., feature, p, value)`.

    A quantile sketch brackets each wanted rank; exact counts below, inside and above
    the bracket say which zone really holds it, and only rows of that zone are taken out
    of the wide table, counted by distinct value and ordered, over ranges where they are
    many. The sketch affects speed, never the result.
    """
    eps = 2e-4
    cells = [(f, i) for f in features for i in range(len(ps))]
    bound = None if groups is None else groups * len(cells)
    rows = df.select(*by, *[F.col(f).cast("double").alias(f) for f in features])
    marks = ", ".join(f"{max(0.0, p - eps)!r}D, {min(1.0, p + eps)!r}D" for p in ps)
    sketch = rows.groupBy(*by).agg(
        *[F.expr(f"percentile_approx(`{f}`, array({marks}), 10000) as `_b_{f}`") for f in features]
    )
    ends = [f"`_b_{f}`[{2 * i + e}] as `_{n}_{c}`" for c, (f, i) in enumerate(cells) for e, n in ((0, "lo"), (1, "hi"))]
    brackets = settle(sketch.selectExpr(*by, *ends), groups)
    counts = [F.expr(f"count(`{f}`) as `_n_{f}`") for f in features]
    for c, (f, _) in enumerate(cells):
        counts += [F.expr(f"count_if(`{f}` < _lo_{c}) as _below_{c}"), F.expr(f"count_if(`{f}` <= _hi_{c}) as _upto_{c}")]
    edges = [f"_{n}_{c}" for c in range(len(cells)) for n in ("lo", "hi")]
    counted = join_small(rows, brackets, by, rows=groups).groupBy(*by, *edges).agg(*counts)
    listed = ", ".join(
        f"{c}, '{f}', {float(ps[i])!r}D, `_n_{f}`, _below_{c}, _upto_{c}, _lo_{c}, _hi_{c}"
        for c, (f, i) in enumerate(cells)
    )
    zone = lambda r: f"CASE WHEN {r} < below THEN 0 WHEN {r} < upto THEN 1 ELSE 2 END"
    plan = (
        counted.selectExpr(*by, f"stack({len(cells)}, {listed}) as (cell, feature, p, n, below, upto, lo, hi)")
        .filter("n > 0")
        .selectExpr("*", "(n - 1) * p as pos")
        .selectExpr("*", "floor(pos) as r0", "ceil(pos) as r1")
        .selectExpr("*", f"{zone('r0')} as z0", f"{zone('r1')} as z1")
        .selectExpr("*", "CASE z0 WHEN 0 THEN 0L WHEN 1 THEN below ELSE upto END as base")
        .selectExpr("*", "CASE z1 WHEN 0 THEN below WHEN 1 THEN upto ELSE n END - base as size")
    )
    plan = settle(plan, bound)
    # Inclusive ends of the zones that hold the two ranks; a value on an end that belongs
    # to the next zone is dropped again below, where few rows are left.
    limits = plan.selectExpr(
        *by,
        "cell",
        "CASE z0 WHEN 0 THEN double('-infinity') WHEN 1 THEN lo ELSE hi END as a",
        "CASE z1 WHEN 0 THEN lo WHEN 1 THEN hi ELSE double('infinity') END as b",
    )
    wanted = limits.groupBy(*by).agg(
        *[F.expr(f"max(CASE WHEN cell = {c} THEN {e} END) as _{e}_{c}") for c in range(len(cells)) for e in "ab"]
    )
    wanted = settle(wanted, groups)
    inside = [f"`{f}` >= _a_{c} AND `{f}` <= _b_{c}" for c, (f, _) in enumerate(cells)]
    found = ", ".join(
        f"CASE WHEN {test} THEN struct({c} as cell, `{f}` as v) END" for c, (test, (f, _)) in enumerate(zip(inside, cells))
    )
    values = (
        join_small(rows, wanted, by, rows=groups)
        .selectExpr(*by, f"explode(array_compact(array({found}))) as _x")
        .selectExpr(*by, "_x.cell as cell", "_x.v as v")
        .groupBy(*by, "cell", "v")
        .agg(F.count("*").alias("_c"))
    )
    key = [*by, "feature", "p"]
    near = (
        join_small(values, plan.drop("n", "below", "upto", "size"), [*by, "cell"], rows=bound)
        .filter("CASE WHEN v < lo THEN 0 WHEN v <= hi THEN 1 ELSE 2 END >= z0")
        .filter("CASE WHEN v < lo THEN 0 WHEN v <= hi THEN 1 ELSE 2 END <= z1")
    )
    ranked = _running(near, [*by, "cell"], [F.col("v")], "_c", "_run", plan, "size").withColumn(
        "_cum", F.col("base") + F.col("_run")
    )
    at = lambda r: F.max(F.when((F.col("_cum") - F.col("_c") <= F.col(r)) & (F.col(r) < F.col("_cum")), F.col("v")))
    frac = F.max(F.col("pos") - F.col("r0"))
    return ranked.groupBy(*key).agg((at("r0") + (at("r1") - at("r0")) * frac).alias("value"))
