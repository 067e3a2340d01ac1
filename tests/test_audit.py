"""Planted faults must be reported, and sound runs must not be."""

from pyspark.sql import functions as F

from holdfast.operators import audit as A
from holdfast.operators.balance import balance
from holdfast.operators.split import holdout
from holdfast.operators.transform import fit_scale

SEEDS = [1, 2]


def test_overlap_and_completeness(cohort):
    splits = holdout(cohort, SEEDS)
    leaked = splits.unionByName(splits.filter("split = 'test' and id < 20").withColumn("split", F.lit("train")))
    n = splits.filter("split = 'test' and id < 20").count()
    assert A.audit_overlap(leaked).count() == n > 0
    bad = leaked.filter("id <> 199").select("seed", "id").unionByName(splits.limit(1).select("seed", F.lit(777).cast("bigint").alias("id")))
    issues = {r["issue"]: r["n"] for r in A.audit_complete(bad, cohort, SEEDS).groupBy("issue").agg(F.count("*").alias("n")).collect()}
    assert issues == {"missing": 2, "foreign": 1, "repeated": n}


def test_copies_count_groups_not_pairs(spark):
    # A third of all rows share one content.
    rows = spark.range(300).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"), F.when(F.col("id") < 100, "same").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    found = A.audit_copies(holdout(rows, SEEDS), rows, ["text"]).collect()
    assert len(found) == 2 and all(r["n_train"] + r["n_test"] == 100 for r in found)
    unique = rows.filter("id >= 100")
    assert A.audit_copies(holdout(unique, SEEDS), unique, ["text"]).count() == 0


def test_near_copies_ignore_case_and_punctuation(spark):
    rows = spark.createDataFrame(
        [(i, int(i % 2), "Hello, World!" if i % 3 else "hello world", 10.0 + 0.1 * (i % 3)) for i in range(40)],
        "id bigint, y int, text string, x double",
    )
    splits = holdout(rows, SEEDS)
    assert A.audit_copies(splits, rows, ["text"]).count() == 4
    near = A.audit_near(splits, rows, {"x": 1.0}, texts=["text"]).collect()
    assert len(near) == 2 and all(r["n_train"] + r["n_test"] == 40 for r in near)


def test_changed_and_copied_test_rows(cohort):
    test = holdout(cohort, SEEDS, keep=["f1"]).filter("split = 'test'").drop("split")
    assert A.audit_test(test, cohort, ["y", "f1"]).count() == 0
    spoiled = test.withColumn("f1", F.when(F.col("id") % 2 == 0, F.col("f1") + 1).otherwise(F.col("f1"))).withColumn("synthetic", F.lit(True))
    issues = {r["issue"] for r in A.audit_test(spoiled, cohort, ["y", "f1"]).collect()}
    assert issues == {"changed", "synthetic"}


def test_balancing_before_the_split_is_seen(cohort):
    splits = holdout(cohort, SEEDS)
    assert A.audit_balance(balance(splits.drop("split"), "even"), splits).count() == 80
    train = splits.filter("split = 'train'").drop("split")
    assert A.audit_balance(balance(train, "even"), splits).count() == 0


def test_parameters_of_all_rows_are_seen(cohort):
    splits = holdout(cohort, SEEDS, keep=["f1", "f2"])
    right = fit_scale(splits.filter("split = 'train'"), ["f1", "f2"])
    full = fit_scale(splits, ["f1", "f2"])
    assert A.audit_params(right, right, full).count() == 0
    bad = A.audit_params(full, right, full).collect()
    assert bad and all(r["matches_full"] for r in bad)
    assert A.audit_params(right.filter("feature = 'f1'"), right, full).count() == 4


def test_chronology(spark):
    good = [("e", 1, s, i) for i, s in enumerate(A.STEPS)]
    bad = [("e", 2, "fit", 1), ("e", 2, "split", 2), ("e", 2, "paint", 3)]
    log = spark.createDataFrame(good + bad, "experiment string, seed int, step string, step_no int").withColumn(
        "at", F.timestamp_seconds(F.col("step_no"))
    )
    found = {(r["seed"], r["step"], r["issue"]) for r in A.audit_order(log).collect()}
    assert found == {(2, "fit", "too early"), (2, "paint", "unknown step")}


def test_shares_and_summary(cohort):
    splits = holdout(cohort, SEEDS)
    skewed = splits.withColumn("split", F.when((F.col("y") == 1) & (F.col("id") < 50), "test").otherwise(F.col("split")))
    assert A.audit_shares(skewed).count() == 2
    table = {r["check"]: r["n_violations"] for r in A.audit_all({"good": A.audit_shares(splits), "bad": A.audit_shares(skewed)}).collect()}
    assert table == {"good": 0, "bad": 2}


def test_content_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        made.add(1)
        return text

    rows = spark.range(200).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"), F.concat(F.lit("a text of five words "), F.col("id") % 90).alias("text"))
    cohort = rows.withColumn("text", counted("text"))
    splits = holdout(rows, SEEDS)
    assert A.audit_similar(splits, cohort, "text").count() > 0
    assert made.value == 200


def test_signatures_of_few_words(spark):
    texts = [None, "", "--", "One, two", "one TWO", "a b c d e f"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [r["s"] for r in rows.select("id", A.band_signatures(F.col("text")).alias("s")).orderBy("id").collect()]
    assert got[:3] == [None] * 3 and got[3] == got[4] != got[5] and len(got[5]) == 10
