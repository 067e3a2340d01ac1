"""The preserved run, weighted fits, encodings with nulls and similar texts."""

from dataclasses import replace

from pyspark.sql import functions as F

from holdfast.operators.audit import audit_similar
from holdfast.operators.balance import even_copies, unbalanced_and_even
from holdfast.operators.model import fit_gnb, fit_gnb_copies
from holdfast.operators.primitives import prefix_sum
from holdfast.operators.split import holdout
from holdfast.operators.transform import apply_encode, apply_select, fit_encode
from holdfast.plans.run import audit_run, audit_summary, evaluate_run

SEEDS = (1, 2)


def counts(df):
    return {r["check"]: r["n_violations"] for r in df.collect()}


def test_run_is_clean_and_a_spoiled_one_is_not(spark, cohort, tmp_path):
    with_null = cohort.withColumn("f2", F.when(F.col("id") % 9 > 0, F.col("f2")))
    run = evaluate_run(with_null, ["f1", "f2"], "small", str(tmp_path / "run"), 1, SEEDS)
    assert set(counts(audit_summary(run)).values()) == {0}
    assert run.manifest.count() == len(SEEDS)
    assert run.provenance.count() == run.metrics.count() == 2 * 2 * 5
    late = F.when(F.col("step") == "split", F.timestamp_seconds(F.unix_seconds("at") + 3600)).otherwise(F.col("at"))
    wrong = replace(
        run,
        params=run.params.withColumn("value", F.when(F.col("stat") == "center", F.col("value") + 1).otherwise(F.col("value"))),
        log=run.log.withColumn("at", late),
        splits=run.splits.unionByName(run.splits.filter("id = 3").withColumn("split", F.lit("other"))),
    )
    found = {name: df.count() for name, df in audit_run(wrong).items() if name in ("params", "order", "overlap", "complete")}
    assert found["params"] > 0 and found["order"] > 0 and found["overlap"] == 2 and found["complete"] == 2


def test_weighted_moments_equal_those_of_copies(cohort):
    train = holdout(cohort, SEEDS, keep=["f1", "f2"]).filter("split = 'train'").drop("split")
    train = train.withColumn("f2", F.when(F.col("id") % 7 > 0, F.col("f2"))).withColumn("f3", F.lit(None).cast("double"))
    feats = ["f1", "f2", "f3"]
    rows = lambda df: sorted(tuple(None if v is None else v if isinstance(v, str) else round(v, 9) for v in r) for r in df.collect())
    copied = fit_gnb(unbalanced_and_even(train, 4), feats, groups=4)
    assert rows(fit_gnb_copies(even_copies(train, 4), feats, 4).select(*copied.columns)) == rows(copied)


def test_null_is_a_level_of_its_own(make):
    train = make([(1, 1, "a"), (1, 0, None), (1, 1, None), (1, 0, "missing"), (1, 0, "")], "seed int, y int, c string")
    seen = make([(1, "a"), (1, None), (1, "missing"), (1, ""), (1, "new")], "seed int, c string")
    for how, want in {
        "ordinal": {None: 0.0, "": 1.0, "a": 2.0, "missing": 3.0, "new": -1.0},
        "target": {"a": 5 / 11, None: 5 / 12, "missing": 4 / 11, "": 4 / 11, "new": 0.4},
        "onehot": {"a": 1.0, None: 1.0, "missing": 1.0, "": 1.0, "new": 0.0},
    }.items():
        got = {r["c"]: round(r["c_code"], 9) for r in apply_encode(seen, fit_encode(train, ["c"], how), ["c"]).collect()}
        assert got == {k: round(v, 9) for k, v in want.items()}, how
    assert fit_encode(train.limit(0), ["c"], "ordinal").count() == 0


def test_unselected_features_become_null(make):
    rows = make([(1, 1.0, 2.0), (2, 3.0, 4.0), (3, 5.0, 6.0)], "seed int, a double, b double")
    chosen = make([(1, "a"), (2, "b")], "seed int, feature string")
    got = {r["seed"]: (r["a"], r["b"]) for r in apply_select(rows, chosen, ["a", "b"], groups=2).collect()}
    assert got == {1: (1.0, None), 2: (None, 4.0), 3: (None, None)}


def test_running_sums_over_ranges_made_by_spark(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), "id", F.lit(1).cast("bigint").alias("one"))
    out = prefix_sum(df, ["g"], None, [F.col("id")], {"one": "upto"})
    assert all(r["upto"] == r["id"] // 2 + 1 for r in out.collect())


def test_similar_texts_are_found_across_sides(make):
    words = [f"word{i * i % 97}x{i}" for i in range(120)]
    changed = [*words[:60], "other", *words[61:]]
    rows = [(1, " ".join(words)), (2, "  ".join(changed).upper()), (3, " ".join(reversed(words))), (4, None), (5, ""), (6, "-- !"), (7, "")]
    rows += [(10 + i, "".join(chr(0x410 + (i * 7 + j) % 32) for j in range(9)) + " 漢字" + str(i)) for i in range(20)]
    cohort = make(rows, "id int, text string")
    splits = cohort.select(F.lit(1).alias("seed"), "id", F.when(F.col("id") % 2 == 0, "test").otherwise("train").alias("split"))
    found = audit_similar(splits, cohort, "text").collect()
    assert 1 <= len(found) <= 10
    assert {(r["n_train"], r["n_test"]) for r in found} == {(1, 1)}
    assert audit_similar(splits.filter("id > 2"), cohort.filter("id > 2"), "text").count() == 0
    assert audit_similar(splits.limit(0), cohort.limit(0), "text").count() == 0
