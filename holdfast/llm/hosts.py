"""Reputation of hosts from labelled outcomes, shrunk level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does.

    A rule (host, path, verdict) fits its host and all subdomains where the path starts
    with the rule's. Of two rules of one length the later one in code point order wins.
    """
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    best = fits[0] if len(fits) == 1 else F.greatest(*fits)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def _strength(level: DataFrame, parent: DataFrame, key: str) -> float:
    """Prior strength of the children under their parents by the method of moments.

    With n outcomes, rate r and parent's rate m, E[n (r - m)^2] = m (1 - m) (1 + (n - 1) rho);
    the strength is 1 / rho - 1. One number; without spread it is large.
    """
    row = (
        level.join(parent.select(F.col(key), F.try_divide("bad", "n").alias("m")), key)
        .where("n > 1 and m > 0 and m < 1")
        .agg(
            F.sum(F.col("n") * (F.try_divide("bad", "n") - F.col("m")) ** 2 - F.col("m") * (1 - F.col("m"))),
            F.sum(F.col("m") * (1 - F.col("m")) * (F.col("n") - 1)),
        )
        .first()
    )
    rho = row[0] / row[1] if row[1] else 0.0
    # six places: sums of doubles arrive in any order
    return round(1.0 / min(max(rho, 1e-3), 0.99) - 1.0, 6)


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str, str]],
    worst: float = 0.5,
    z: float = 1.645,
    id: str = "id",
    url: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict, posterior, bound), one row per page.

    The cohort of this library has no web addresses, so the operator is general: `pages`
    holds (id, url), `outcomes` (id, y) with y = 1 for a bad page. Where a rule fits, its
    verdict holds. Elsewhere the host's share of bad pages decides: outcomes are counted by
    host, registered domain (last two labels; three under a two-letter suffix with a short
    second label) and suffix. A level's posterior mean is (bad + s * prior) / (n + s), its
    prior the posterior of the level above, from suffix to domain to host, and s the level's
    beta-binomial strength fitted by moments. A page is blocked where the lower bound of the
    beta posterior (mean - z standard deviations) is over `worst`.

    Null urls and urls without :// have an empty host, a host like any other. Null y and ids
    that match no page count for nothing; several outcomes of one page count each. Without
    outcomes nothing is blocked by reputation. Every page gives one row, repeated ids too.
    """
    at = pages.select(F.col(id).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if rules:
        at = at.withColumn("_hit", rule_for(F.col("host"), F.col("path"), rules))
    else:
        at = at.withColumn("_hit", F.lit(None).cast("struct<rule:string,verdict:string>"))
    seen = outcomes.where("y is not null and id is not null").groupBy(F.col("id").alias("_id")).agg(F.sum("y").cast("double").alias("_bad"), F.count(F.lit(1)).cast("double").alias("_n"))
    hosts = (
        at.join(seen, F.col("id") == F.col("_id"), "left")
        .groupBy("host")
        .agg(F.coalesce(F.sum("_bad"), F.lit(0.0)).alias("bad"), F.coalesce(F.sum("_n"), F.lit(0.0)).alias("n"))
        .withColumn("_labels", F.split("host", r"\."))
        .withColumn("suffix", F.element_at("_labels", -1))
        .withColumn("_wide", (F.length("suffix") == 2) & (F.size("_labels") > 2) & (F.length(F.element_at("_labels", F.when(F.size("_labels") > 1, -2).otherwise(-1))) <= 3))
        .withColumn("domain", F.array_join(F.slice("_labels", F.greatest(F.lit(1), F.size("_labels") - F.when(F.col("_wide"), 2).otherwise(1)), F.lit(3)), "."))
        .select("host", "domain", "suffix", "bad", "n")
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    total = suffixes.agg(F.sum("bad"), F.sum("n")).first()
    base = (total[0] or 0.0) / total[1] if total[1] else 0.0
    top = suffixes.withColumn("root", F.lit(1))
    one = top.groupBy("root").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    s0, s1, s2 = _strength(top, one, "root"), _strength(domains, suffixes, "suffix"), _strength(hosts, domains, "domain")
    top = top.select("suffix", ((F.col("bad") + s0 * base) / (F.col("n") + s0)).alias("p0"))
    mid = domains.join(top, "suffix").select("domain", ((F.col("bad") + s1 * F.col("p0")) / (F.col("n") + s1)).alias("p1"))
    mean = (F.col("bad") + s2 * F.col("p1")) / (F.col("n") + s2)
    known = hosts.join(mid, "domain").select(
        F.col("host").alias("_host"), mean.alias("posterior"),
        (mean - z * F.sqrt(mean * (1 - mean) / (F.col("n") + s2 + 1))).alias("bound"),
    )
    return at.join(known, F.col("host") == F.col("_host"), "left").select(
        "id", "host", "path", F.col("_hit.rule").alias("rule"),
        F.coalesce(F.col("_hit.verdict"), F.when(F.col("bound") > worst, "block").otherwise("allow")).alias("verdict"),
        "posterior", "bound",
    )
