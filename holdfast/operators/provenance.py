"""From a reported number back to its experiment, configuration and input."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CHAIN = ("result_id", "experiment", "config", "script", "input_fp")


def trace(claims: DataFrame, provenance: DataFrame, manifest: DataFrame) -> DataFrame:
    """claim -> result -> experiment -> config -> script -> input, nulls where broken.

    `provenance` names the result of a claim; the manifest, found by that result, says
    how it was made; of several runs with one result the newest says it.
    """
    links = provenance.select("claim_id", "result_id", "figure")
    how = F.struct("experiment", "config", "script", "input_fp")
    newest = F.max_by(how, F.struct("created_at", how)) if "created_at" in manifest.columns else F.max(how)
    made = manifest.groupBy("result_id").agg(newest.alias("_how")).select("result_id", "_how.*")
    return (
        claims.select("claim_id", "metric", "strategy")
        .join(links, "claim_id", "left")
        .join(made, "result_id", "left")
        .select("claim_id", "metric", "strategy", *CHAIN, "figure")
    )


def broken_links(traced: DataFrame, manifest: DataFrame) -> DataFrame:
    """First missing step of each broken claim, and results that no claim uses."""
    missing = F.lit(None).cast("string")
    for step in reversed(CHAIN):
        missing = F.when(F.col(step).isNull(), step).otherwise(missing)
    claims = traced.withColumn("missing", missing).filter(F.col("missing").isNotNull()).select(
        F.lit("claim").alias("kind"), F.col("claim_id").alias("ref"), "missing"
    )
    used = traced.select("result_id").filter(F.col("result_id").isNotNull())
    unused = manifest.join(used, "result_id", "left_anti").select(
        F.lit("result").alias("kind"), F.col("result_id").alias("ref"), F.lit("claim").alias("missing")
    )
    return claims.unionByName(unused.distinct())


def check_claims(claims: DataFrame, found: DataFrame) -> DataFrame:
    """Round the recomputed value to the claimed decimals and compare.

    `found` is `(metric, strategy, stat, value)`; claims carry `stat` as well (mean, sd,
    p_value...). Where both sides name an experiment or a model these must agree too, null
    with null. Status: confirmed, contradicted or no result.
    """
    on = [c for c in ("experiment", "model") if c in claims.columns and c in found.columns]
    scale = F.pow(F.lit(10.0), F.col("decimals").cast("double"))
    rounded = F.round(F.col("value") * scale) / scale
    return (
        claims.alias("c")
        .join(
            found.select("metric", "strategy", "stat", "value", *on).alias("f"),
            reduce(and_, [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in ("metric", "strategy", "stat", *on)]),
            "left",
        )
        .select("c.*", "f.value")
        .withColumn("recomputed", rounded)
        .withColumn(
            "status",
            F.when(F.col("value").isNull(), "no result")
            .when(F.abs(F.col("recomputed") - F.col("claimed_value")) * scale < 0.5, "confirmed")
            .otherwise("contradicted"),
        )
        .select("claim_id", "metric", "strategy", "stat", "claimed_value", "recomputed", "status")
    )


def long_found(summary: DataFrame, tests: DataFrame) -> DataFrame:
    """Summary and test tables as the `(metric, strategy, stat, value)` of `check_claims`."""
    means = summary.select("metric", "strategy", F.expr("stack(2, 'mean', mean, 'sd', sd) as (stat, value)"))
    ps = tests.select("metric", F.lit("both").alias("strategy"), F.concat("test", F.lit("_p")).alias("stat"), F.col("p_value").alias("value"))
    return means.unionByName(ps)


def resolve_evidence(results: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key: corrected over historical, leakage-safe over not, newest version.

    An aggregate, not a window: many versions of one key collapse map-side. `result_id`
    settles equal claims.
    """
    values = [c for c in results.columns if c not in key]
    order = F.struct(
        F.col("corrected").cast("int"), F.col("leakage_safe").cast("int"), F.col("version"), F.col("result_id")
    )
    best = results.groupBy(*key).agg(F.max_by(F.struct(*values), order).alias("_best"))
    return best.select(*key, "_best.*")


def scope_gate(claims: DataFrame, scope: DataFrame, found: DataFrame) -> DataFrame:
    """Flags claims on unsupported topics, on unlisted topics, or without a result.

    `scope` is `(topic, supported)`.
    """
    have = found.select("metric", "strategy").distinct().withColumn("_have", F.lit(True))
    return (
        claims.join(scope.select("topic", "supported"), "topic", "left")
        .join(have, ["metric", "strategy"], "left")
        .select(
            "claim_id",
            "topic",
            F.when(F.col("supported").isNull(), "topic not listed")
            .when(~F.col("supported"), "unsupported topic")
            .when(F.col("_have").isNull(), "no result")
            .otherwise("in scope")
            .alias("gate"),
        )
    )


def fingerprint(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Digest of a table that no row order or partitioning can change.

    The md5 of each row, cut in four 32-bit numbers that are summed exactly. Values are
    written with their length, so that neighbouring columns cannot run together.
    """
    parts = []
    for c in cols or df.columns:
        text = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    key = F.md5(F.concat_ws("|", *parts))
    sums = [
        F.coalesce(
            F.sum(F.conv(F.substring(key, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")),
            F.lit(0).cast("decimal(38,0)"),
        ).alias(f"s{i}")
        for i in range(4)
    ]
    digest = F.md5(F.concat_ws("|", F.col("n_rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)]))
    return df.agg(F.count("*").alias("n_rows"), *sums).select("n_rows", digest.alias("fingerprint"))


def rerun_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one run but not in the other, with multiplicity: `(cols..., side, n_extra)`.

    Both runs are counted in one aggregate with opposite signs: one shuffle instead of
    the two set differences.
    """
    cols = a.columns
    signed = a.withColumn("_s", F.lit(1)).unionByName(b.select(*cols).withColumn("_s", F.lit(-1)))
    net = signed.groupBy(*cols).agg(F.sum("_s").alias("_net")).filter(F.col("_net") != 0)
    return net.select(
        *cols,
        F.when(F.col("_net") > 0, "only_a").otherwise("only_b").alias("side"),
        F.abs("_net").alias("n_extra"),
    )
