import hashlib

import pytest
from pyspark.sql import functions as F

from holdfast.operators import audit as A
from holdfast.operators.provenance import fingerprint
from holdfast.operators.split import freeze, holdout, inner_holdout, plan_holdout, quotas, split_report
from holdfast.session import new_path

SEEDS = [1, 2, 3]


def test_matches_the_plain_definition(cohort):
    got = {(r["seed"], r["id"]): r["split"] for r in holdout(cohort, SEEDS).collect()}
    rows = [(r["id"], r["y"]) for r in cohort.select("id", "y").collect()]
    for seed in SEEDS:
        for y, k in ((1, 12), (0, 28)):
            ids = sorted((hashlib.md5(f"{seed}|split|{i}".encode()).hexdigest(), i) for i, c in rows if c == y)
            assert {i for _, i in ids[:k]} == {i for i, c in rows if c == y and got[(seed, i)] == "test"}


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_layout_does_not_matter(spark, cohort, parts):
    want = fingerprint(holdout(cohort, SEEDS)).first()
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = fingerprint(holdout(cohort.repartition(parts, F.xxhash64("id", "h")), SEEDS)).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == want


def test_largest_remainder(make):
    out = quotas(make([("1", 94), ("0", 99)], "stratum string, n bigint"), [], 200).collect()
    assert {r["stratum"]: r["k"] for r in out} == {"1": 19, "0": 20}
    big = quotas(make([("1", 4 * 10**11), ("0", 6 * 10**11)], "stratum string, n bigint"), [], 200).collect()
    assert sum(r["k"] for r in big) == 2 * 10**11
    # A stratum of one row, and an equal remainder that goes to the smaller label.
    tiny = quotas(make([("a", 1), ("b", 1)], "stratum string, n bigint"), [], 500).collect()
    assert {r["stratum"]: r["k"] for r in tiny} == {"a": 1, "b": 0}


def test_audits_pass_on_a_good_split(cohort):
    splits = holdout(cohort, SEEDS, keep=["f1"]).cache()
    assert A.audit_overlap(splits).count() == 0
    assert A.audit_complete(splits, cohort, SEEDS).count() == 0
    assert A.audit_shares(splits).count() == 0
    assert [r["n_test"] for r in split_report(splits).collect()] == [40, 40, 40]


def test_entities_stay_whole(cohort):
    splits = holdout(cohort, SEEDS, entity="entity_id")
    assert A.audit_entity(splits, cohort).count() == 0
    assert splits.count() == 600
    by_row = holdout(cohort, SEEDS)
    assert A.audit_entity(by_row, cohort).count() > 0


def test_one_hot_entity_among_many(spark, cohort):
    hot = cohort.withColumn("entity_id", F.when(F.col("id") < 80, -1).otherwise(F.col("entity_id")))
    sides = holdout(hot, SEEDS, entity="entity_id").filter("entity_id = -1").groupBy("seed").agg(F.count_distinct("split").alias("n"), F.count("*").alias("c"))
    assert {(r["n"], r["c"]) for r in sides.collect()} == {(1, 80)}


def test_inner_split_stays_inside_training(cohort):
    splits = holdout(cohort, SEEDS)
    inner = inner_holdout(splits, 0.25)
    counts = {(r["seed"], r["split"]): r["count"] for r in inner.groupBy("seed", "split").count().collect()}
    assert counts == {(s, p): n for s in SEEDS for p, n in (("fit", 120), ("valid", 40))}
    test = splits.filter("split = 'test'").select("seed", "id")
    assert inner.join(test, ["seed", "id"]).count() == 0


def test_freeze_reads_back_and_prunes(spark, cohort):
    frozen = freeze(holdout(cohort, SEEDS), new_path(spark, "splits"))
    one = frozen.filter("seed = 2")
    assert one.count() == 200
    assert "PartitionFilters: [isnotnull(seed" in one._jdf.queryExecution().toString()


def test_frozen_types_hold(spark, make):
    rows = make([("007", 1, "train"), ("1e3", 2, "test"), (None, 3, "train")], "seed string, id int, split string")
    frozen = freeze(rows, new_path(spark, "splits"))
    assert dict(frozen.dtypes) == dict(rows.dtypes)
    assert {tuple(r) for r in frozen.select("seed", "id").collect()} == {("007", 1), ("1e3", 2), (None, 3)}
    assert freeze(rows.where("false"), new_path(spark, "splits")).dtypes == frozen.dtypes


def test_one_class_and_empty(spark, cohort):
    ones = holdout(cohort.filter("y = 1"), [1])
    assert ones.filter("split = 'test'").count() == 12
    assert holdout(cohort.filter("false"), [1]).count() == 0


def test_plan_knows_its_training_sizes(cohort):
    plan = plan_holdout(cohort, SEEDS)
    got = {(r["seed"], r["y"]): r["n"] for r in plan.train_sizes().collect()}
    assert got == {(s, y): n for s in SEEDS for y, n in ((0, 112), (1, 48))}


def test_no_bulk_shuffle_in_the_last_pass(cohort):
    plan = plan_holdout(cohort, SEEDS).apply(cohort)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
