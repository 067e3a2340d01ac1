"""Leakage audit. Each check returns violations as rows; no rows means it passed.

Copies are reported as counts per content and seed, never as pairs of rows, so a group
of copies holding a third of the data costs one counter per map task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.operators.balance import even_copies
from holdfast.operators.primitives import lookup, settle
from holdfast.operators.split import holdout, split_report

# The order in which a run may do its steps.
STEPS = ("split", "freeze", "balance", "fit", "predict", "evaluate")


def audit_overlap(splits: DataFrame) -> DataFrame:
    """Ids on both sides for one seed."""
    sides = splits.groupBy("seed", "id").agg(F.min("split").alias("_a"), F.max("split").alias("_b"))
    return sides.filter(F.col("_a") != F.col("_b")).select("seed", "id")


def audit_entity(splits: DataFrame, cohort: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Entities with rows on both sides: `(seed, entity, n_train, n_test)`.

    Rows without a known entity cannot be judged; they are reported under a null entity.
    """
    rows = splits if entity in splits.columns else splits.join(cohort.select("id", entity), "id", "left")
    return _sides(rows, ["seed", entity]).filter(f"{_BOTH} or `{entity}` is null")


_BOTH = "n_train > 0 and n_test > 0"


def _both_sides(rows: DataFrame, keys: list[str]) -> DataFrame:
    return _sides(rows, keys).filter(_BOTH)


def _sides(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
    )


def content_key(parts: Sequence[Column]) -> Column:
    """Digest of the parts, each with its length in front, so that no two rows run together."""
    text = [p.cast("string") for p in parts]
    return F.md5(F.concat(*[F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]))


def audit_copies(splits: DataFrame, cohort: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Identical content with different ids in train and test, per (seed, content)."""
    keyed = cohort.select("id", content_key([F.col(c) for c in cols]).alias("content"))
    return _content_on_both_sides(splits, keyed)


def audit_near(
    splits: DataFrame, cohort: DataFrame, quanta: Mapping[str, float], texts: Sequence[str] = (), exact: Sequence[str] = ()
) -> DataFrame:
    """Near copies across sides, per (seed, content).

    Rows are near copies when every number falls in the same step of its quantum, every
    text agrees on its letters and digits, of any script, regardless of case, and `exact` columns agree.
    """
    parts = [F.floor(F.col(c).cast("double") / F.lit(float(q))) for c, q in quanta.items()]
    parts += [F.lower(F.regexp_replace(F.col(c), r"[^\p{L}\p{N}]+", "")) for c in texts]
    parts += [F.col(c) for c in exact]
    return _content_on_both_sides(splits, cohort.select("id", content_key(parts).alias("content")))


# Fixed value: a prime above the 28-bit digests of shingles, for linear hash functions.
PRIME = 2**31 - 1


def linear_hashes(count: int) -> list[tuple[int, int]]:
    """Factors and offsets of `count` hash functions, drawn by digest."""
    draw = lambda kind, i: int(md5(f"{kind}{i}".encode()).hexdigest()[:12], 16)
    return [(1 + draw("a", i) % (PRIME - 1), draw("b", i) % PRIME) for i in range(count)]


def band_signatures(text: Column, bands: int = 10, rows: int = 4, words: int = 5) -> Column:
    """Min-hash signatures of a text's word shingles, one per band, as an array of strings.

    Words are runs of letters and digits of any script, regardless of case; a shorter
    text is one shingle, a text without words has no signature. Two texts whose shingles
    agree to a share s have a signature in common with probability 1 - (1 - s^rows)^bands:
    0.995 at 0.8, 0.08 at 0.3.
    """
    plain = F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))
    prime, drawn = PRIME, linear_hashes(bands * rows)

    def signature(text: str | None) -> list[str] | None:
        if not text:
            return None
        parts = text.split(" ")
        shingles = {" ".join(parts[i : i + words]) for i in range(max(len(parts) - words + 1, 1))}
        xs = np.array([int.from_bytes(md5(s.encode()).digest()[:4], "big") >> 4 for s in shingles], dtype=np.int64)
        least = [str(((xs * a + b) % prime).min()) for a, b in drawn]
        cut = ["|".join(least[i * rows : (i + 1) * rows]) for i in range(bands)]
        return [f"{i}:{md5(part.encode()).hexdigest()}" for i, part in enumerate(cut)]

    @F.pandas_udf("array<string>")
    def signatures(texts: pd.Series) -> pd.Series:
        return pd.Series([signature(t) for t in texts], dtype=object)

    return signatures(plain)


def audit_similar(
    splits: DataFrame, cohort: DataFrame, text: str, bands: int = 10, rows: int = 4, words: int = 5
) -> DataFrame:
    """Texts that share most of their word shingles across sides, per (seed, signature).

    `content` is a band and the digest of its min-hashes (see `band_signatures`). Rows are
    counted by signature, never paired.
    """
    signatures = band_signatures(F.col(text), bands, rows, words)
    return _content_on_both_sides(splits, cohort.select("id", F.explode(signatures).alias("content")))


def _content_on_both_sides(splits: DataFrame, keyed: DataFrame) -> DataFrame:
    keyed = settle(keyed)  # read three times below, and made from whole texts
    repeated = (
        keyed.groupBy("content")
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > 1)
        .withColumn("_repeated", F.lit(True))
    )
    rows = lookup(keyed, repeated, "content", "_n").filter("_repeated").drop("_repeated")
    return _both_sides(splits.select("seed", "id", "split").join(rows, "id"), ["seed", "content"])


def audit_complete(splits: DataFrame, cohort: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """(seed, id) that are missing, repeated or foreign, or carry a seed not planned.

    Splits are folded map-side to one counter per seed and id before they meet the
    cohort, so the join sees each id once, however often it is repeated.
    """
    seeds = [int(s) for s in seeds]
    per_id = splits.groupBy("id").agg(
        *[F.count_if(F.col("seed") == s).alias(f"_n{i}") for i, s in enumerate(seeds)],
        F.count_if(~F.coalesce(F.col("seed").isin(*seeds), F.lit(False))).alias("_other"),
    )
    both = cohort.select("id", F.lit(True).alias("_known")).join(per_id, "id", "full_outer")
    known = F.coalesce("_known", F.lit(False))

    def found(cond: Column, seed: int | None, issue: str) -> Column:
        return F.when(cond, F.struct(F.lit(seed).cast("int").alias("seed"), F.lit(issue).alias("issue")))

    checks = [found(F.coalesce("_other", F.lit(0)) > 0, None, "unplanned seed")]
    for i, s in enumerate(seeds):
        n = F.coalesce(F.col(f"_n{i}"), F.lit(0))
        checks += [
            found(known & (n == 0), s, "missing"),
            found(~known & (n > 0), s, "foreign"),
            found(n > 1, s, "repeated"),
        ]
    issues = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return both.select("id", F.explode(issues).alias("_x")).select("_x.seed", "id", "_x.issue")


def audit_test(test: DataFrame, cohort: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Test rows that are not the cohort's rows: `(seed, id, issue)`.

    Issues: `foreign` id, `changed` content, `copy` (copy_no > 0), `synthetic`,
    `repeated`. Rows are compared by a digest, so wide columns meet only once.
    """
    key = content_key([F.col(c) for c in cols])
    flag = lambda c, zero: F.col(c) if c in test.columns else F.lit(zero)
    rows = (
        test.select(
            "seed",
            "id",
            key.alias("_key"),
            (F.coalesce(flag("copy_no", 0), F.lit(0)) > 0).alias("_copy"),
            F.coalesce(flag("synthetic", False), F.lit(False)).alias("_synthetic"),
        )
        .groupBy("seed", "id")
        .agg(
            F.count("*").alias("_n"),
            F.min("_key").alias("_lo"),
            F.max("_key").alias("_hi"),
            F.max("_copy").alias("_copy"),
            F.max("_synthetic").alias("_synthetic"),
        )
    )
    both = rows.join(cohort.select("id", key.alias("_true")), "id", "left")
    differs = F.col("_true").isNotNull() & ((F.col("_lo") != F.col("_true")) | (F.col("_hi") != F.col("_true")))
    checks = {
        "foreign": F.col("_true").isNull(),
        "changed": differs,
        "copy": F.col("_copy"),
        "synthetic": F.col("_synthetic"),
        "repeated": F.col("_n") > 1,
    }
    found = F.filter(
        F.array(*[F.when(cond, F.lit(name)) for name, cond in checks.items()]), lambda x: x.isNotNull()
    )
    return both.select("seed", "id", F.explode(found).alias("issue"))


def audit_balance(train_set: DataFrame, splits: DataFrame) -> DataFrame:
    """Balanced rows whose id is not a training id of that seed."""
    train = splits.filter(F.col("split") == "train").select("seed", "id")
    return (
        train_set.groupBy("seed", "strategy", "id")
        .agg(F.count("*").alias("n_rows"))
        .join(train, ["seed", "id"], "left_anti")
        .select("seed", "strategy", "id", "n_rows")
    )


PARAM_KEYS = ["seed", "transform", "feature", "stat"]


def audit_params(
    params: DataFrame, refit_train: DataFrame, refit_all: DataFrame, tol: float = 1e-6, keys: Sequence[str] = PARAM_KEYS
) -> DataFrame:
    """Stored parameters that a refit on training rows does not give.

    `matches_full` marks those a refit on all rows gives, the sign of a fit before the
    split. The tolerance is relative.
    """
    keys = list(keys)
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= tol * F.greatest(F.lit(1.0), F.abs(F.col(b)))
    names = ("stored", "from_train", "from_all")
    tagged = [df.select(*keys, F.lit(n).alias("_from"), "value") for n, df in zip(names, (params, refit_train, refit_all))]
    # Grouping takes null keys (the levels of an encoding) as equal, a join would not.
    joined = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy(*keys).agg(
        *[F.max(F.when(F.col("_from") == n, F.col("value"))).alias(n) for n in names]
    )
    bad = ~F.coalesce(near("stored", "from_train"), F.lit(False)) & ~(
        F.col("stored").isNull() & F.col("from_train").isNull()
    )
    return joined.filter(bad).withColumn("matches_full", F.coalesce(near("stored", "from_all"), F.lit(False)))


def audit_order(log: DataFrame, steps: Sequence[str] = STEPS) -> DataFrame:
    """Steps that began before an earlier step had ended, per (experiment, seed).

    The log is folded to first and last time per step (map-side), so the window sees at
    most one row per step however long the log is. Unknown steps are reported too.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in steps]), F.col("step"))
    spans = log.groupBy("experiment", "seed", "step").agg(
        F.min(F.struct("at", "step_no")).alias("_first"), F.max(F.struct("at", "step_no")).alias("_last")
    ).withColumn("_place", place)
    w = W.partitionBy("experiment", "seed").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    seen = spans.withColumn("_before", F.max(F.when(F.col("_place") > 0, F.col("_last"))).over(w))
    early = (F.col("_place") > 0) & (F.col("_first") < F.col("_before"))
    issue = F.when(F.col("_place") == 0, "unknown step").when(early, "too early")
    return seen.withColumn("issue", issue).filter(F.col("issue").isNotNull()).select(
        "experiment",
        "seed",
        "step",
        F.col("_first.at").alias("first_at"),
        F.when(F.col("_place") > 0, F.col("_before.at")).alias("previous_end"),
        "issue",
    )


def audit_shares(splits: DataFrame) -> DataFrame:
    """Seeds whose test positives are more than one row off the cohort share."""
    rep = split_report(splits)
    expected = F.col("share_all") * F.col("n_test")
    return rep.withColumn("expected", expected).filter(F.abs(F.col("pos_test") - F.col("expected")) > 1).select(
        "seed", "n_test", "pos_test", "expected"
    )


def leaky_sides(cohort: DataFrame, seeds: Sequence[int], features: Sequence[str], frac: float = 0.2) -> DataFrame:
    """The mistake: balance the whole cohort, then split the copies by row.

    Returns `(seed, id, y, split, features...)` with one row per copy; it exists so
    that its effect on the metrics can be measured.
    """
    whole = cohort.select(F.lit(0).alias("seed"), "id", "y", *features)
    copies = even_copies(whole, groups=2)
    rows = copies.withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    rows = rows.withColumn("id", F.concat_ws("#", F.col("id").cast("string"), F.col("_c").cast("string")))
    return holdout(rows.select("id", "y", *features), seeds, frac, keep=features)


def leak_effect(wrong: DataFrame, right: DataFrame) -> DataFrame:
    """Metric with balancing before the split (wrong) minus after it (right)."""
    keys = ["experiment", "model", "metric", "seed"]
    tagged = wrong.select(*keys, F.lit("wrong").alias("_w"), "value").unionByName(
        right.select(*keys, F.lit("right").alias("_w"), "value")
    )
    both = tagged.groupBy(*keys).agg(
        F.max(F.when(F.col("_w") == "right", F.col("value"))).alias("right"),
        F.max(F.when(F.col("_w") == "wrong", F.col("value"))).alias("wrong"),
    )
    return both.withColumn("diff", F.col("wrong") - F.col("right"))


def audit_all(checks: Mapping[str, DataFrame]) -> DataFrame:
    """`(check, n_violations)` for every check, including those that found nothing."""
    out = None
    for name, df in checks.items():
        row = df.agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("check"), "n_violations")
        out = row if out is None else out.unionByName(row)
    return out
